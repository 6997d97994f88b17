"""Benchmark decontamination with templates.

Text is made canonical word by word: capitals of one or two bytes folded and ASCII punctuation at the edges dropped;
numbers become a number slot, words with a capital that do not open a sentence or line a
name slot, and words of a unit list a unit slot (those that are also plain words only right
after a number). A capital that opens a sentence or line has two readings, the one of the
word without it and a name: item windows are kept in every combination of them, document
windows looked up with all openings read the first way and with all read as names. So
neither another name nor other text before an item hides it; what is not seen is a window
where a document makes a small word of the item an opening and has another name at another
opening. Windows of `window` canonical words of benchmark items are looked up among those
of all documents (items shorter than a window count whole, as templates from `shortest`
words on). A window where a benchmark item has too few plain words to tell is extended until
it has `plain` of them. Where that fails (also with openings as names only), and in items
under `shortest` words, the window is looked up by its folded words, slots included.
Left out are items of one or two words and windows of nothing but numbers: they say too
little to be an item's alone.

A window's key is the hash of its template and of the pattern in which its slot values
repeat, so what a hash join of the keys brings together agrees in both unless hashes
collide. A hit is then confirmed slot by slot: plain words must be equal, and over the window
each slot value of the item must stand for one value in the document and the other way
round, so that a question with other numbers, names or units is caught, and a text that only
has the same shape is not. A document is contaminated by an item with any confirmed hit.

Both sides are tables. Items with the same keys - copies, and one question with other numbers
- are one class and give one row for each document, under the least item id. Of document
windows only those travel that a bitmap of the items' templates lets through; it is bounded
by FILTER_BITS, beyond which it only lets more through. Null texts have no words; null ids
are kept; equal rows give equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, runs, saved, session
from .textkit import U64, Words, hash_spans, mix, powers, rolling_sums
from .toxicity import PUNCTUATION as _PUNCTUATION
from .toxicity import word_spans

WINDOW, SHORTEST, PLAIN = 13, 8, 5
#: Words of the shortest item that is looked up at all.
LEAST = 3
#: Bits of the bitmap at most (16 MB), and of those one stands for a block that one task fills.
FILTER_BITS, BLOCK_BITS = 27, 20
#: Openings in the words that a window is looked up by; where it has more, its first words up
#: to there are looked up and all of it is confirmed.
OPENINGS = 8
#: Cells of comparisons in hand at once.
CELLS = 1 << 20
# Words that are units, and units that are plain words too unless a number stands before them.
UNITS = ("mm", "cm", "km", "inch", "inches", "ft", "feet", "foot", "yd", "yard", "yards", "mi", "mile", "miles", "mg", "kg", "lb", "lbs", "oz", "ounce", "ounces", "pound", "pounds", "ton", "tons", "ml", "liter", "liters", "litre", "litres", "gallon", "gallons", "ms", "minute", "minutes", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "usd", "eur", "gbp", "dollar", "dollars", "euro", "euros", "cent", "cents", "kb", "mb", "gb", "kw", "hz", "khz", "mhz", "ghz", "percent", "degrees")
SMALL_UNITS = ("m", "in", "min", "g", "l", "s", "sec", "second", "seconds", "h", "w", "v", "tb")
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
_SLOT = mix(np.arange(1, 5, dtype=U64) * U64(0xD6E8FEB86659FD93))
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True
#: Whether a code point under 0x10000 past ASCII is a capital.
_CAPITAL = np.array([c > 127 and chr(c).isupper() for c in range(1 << 16)])


def _first_point(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code point of two or three bytes at each place, 0 for others."""
    a, b, c = (data[np.minimum(at + i, len(data) - 1)].astype(np.int32) for i in range(3))
    two, three = ((a & 31) << 6) | (b & 63), ((a & 15) << 12) | ((b & 63) << 6) | (c & 63)
    return np.where((a >= 0xC2) & (a < 0xE0), two, np.where((a >= 0xE0) & (a < 0xF0), three, 0))


#: The code points under 0x800, small where that is one of them too.
_SMALL = np.array([ord(x) if len(x := chr(c).lower()) == 1 and 127 < ord(x) < 0x800 else c for c in range(0x800)])


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 with capitals of one and two bytes made small."""
    out = np.where(_UPPER[data], data + 32, data).astype(np.uint8)
    at = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] < 0xE0))
    point = _SMALL[((data[at].astype(np.int32) & 31) << 6) | (data[at + 1] & 63)]
    out[at], out[at + 1] = 0xC0 | (point >> 6), 0x80 | (point & 63)
    return out


class Canonical:
    """Per word of a batch (words of punctuation alone are left out): its kind, its value (hash
    of the folded word), its canonical hash, its place among all words of its text, whether it
    is a capital that opens a sentence or line, and kind and canonical hash with those as names."""

    def __init__(self, texts: list[str | None]):
        words = Words(texts)
        data = words.data
        start, end = word_spans(words)
        value = hash_spans(folded(data), start, end)
        kind = np.full(len(value), LITERAL, np.int8)
        keep = np.ones(len(value), bool)
        opening = np.zeros(len(value), bool)
        if len(value):
            head = data[start]
            capital = _UPPER[head] | _CAPITAL[_first_point(data, start)]
            opens = np.zeros(len(value), bool)
            opens[words.first[:-1][words.counts > 0]] = True
            opens[1:] |= _STOP[data[words.end[:-1] - 1]]
            newline = np.append(0, np.cumsum(data == 10))
            opens[1:] |= newline[words.start[1:]] > newline[words.end[:-1]]
            number = _DIGIT[head]
            after = np.append(False, number[:-1] & (words.owner()[1:] == words.owner()[:-1]))
            kind[np.isin(value, UNIT_HASHES) | (after & np.isin(value, SMALL_UNIT_HASHES))] = UNIT
            kind[capital & ~opens] = NAME
            opening = capital & opens
            # signs and currencies are punctuation, which is dropped already
            kind[number] = NUMBER
            solid = np.append(0, np.cumsum(~_PUNCTUATION[data]))
            keep = solid[words.end] > solid[words.start]
        self.first = np.append(0, np.cumsum(keep))[words.first]
        self.place = (np.arange(len(value)) - np.repeat(words.first[:-1], words.counts))[keep]
        self.kind, self.value, self.opening = kind[keep], value[keep], opening[keep]
        self.canon = np.where(self.kind == LITERAL, self.value, _SLOT[self.kind])
        self.named = np.where(self.opening, NAME, self.kind)
        self.canon_named = np.where(self.opening, _SLOT[NAME], self.canon)


def _hashes(words: list[str]) -> np.ndarray:
    w = Words(words)
    return np.sort(w.hash)


UNIT_HASHES, SMALL_UNIT_HASHES = _hashes(UNITS), _hashes(SMALL_UNITS)


def _before(mask: np.ndarray) -> np.ndarray:
    """How many are set before each place, and in all at the end."""
    return np.append(0, np.cumsum(mask))


def _mark(width: int, size: int, exact: bool) -> np.uint64:
    return mix(np.array([(width << 20) + (size << 1) + exact + 1], U64))[0]


def pattern(kind: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Hash of the places at which the slot values of each window (a row) stand first."""
    n, width = kind.shape
    out = np.empty(n, U64)
    weight = powers(width + 1)[1:]
    step = max(1, CELLS // max(1, width * width))
    for a in range(0, n, step):
        k, v = kind[a : a + step], value[a : a + step]
        same = (k[:, :, None] == k[:, None, :]) & (v[:, :, None] == v[:, None, :])
        first = np.where(k == LITERAL, 0, same.argmax(2) + 1).astype(U64)
        out[a : a + step] = (first * weight).sum(1, dtype=U64)
    return mix(out)


def item_windows(texts: list[str | None], window: int, shortest: int, plain: int) -> Iterator[dict]:
    """The windows of items as they are looked up, in groups of one width, size and kind of
    lookup: text, start, width, size, exact, the template's hash, key, and payload."""
    c = Canonical(texts)
    n = np.diff(c.first)
    fits = np.where(n >= LEAST, n - np.minimum(window, n) + 1, 0)
    every = runs(c.first[:-1], fits)
    last = np.repeat(c.first[1:], fits)
    sizes = np.repeat(np.minimum(window, n), fits)
    most, least = _before(c.kind == LITERAL), _before((c.kind == LITERAL) & ~c.opening)
    long = np.repeat(n >= shortest, fits)
    start, end, length = every[long], last[long], sizes[long]
    starts, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(start):
        # extend a window that is mostly slots, in steps, so that few lengths occur, and at
        # last to the item's end; one that is so only with its openings as names counts at
        # each length
        enough = most[start + length] - most[start] >= plain
        starts.append(start[enough])
        lengths.append(length[enough])
        more = (least[start + length] - least[start] < plain) & (start + length < end) & (length < 2 * window)
        start, end, length = start[more], end[more], np.minimum(length[more] + 4, (end - start)[more])
    start, size = np.concatenate(starts), np.concatenate(lengths)
    openings = _before(c.opening)
    width = np.minimum(size, np.searchsorted(openings, openings[start] + OPENINGS, "right") - 1 - start)
    telling = _before(c.kind != NUMBER)
    told = start[least[start + size] - least[start] >= plain]
    exact = ~np.isin(every, told) & (telling[every + sizes] > telling[every])

    def group(at: np.ndarray, width: int, size: int, exact: bool, template: np.ndarray, key: np.ndarray) -> dict:
        place = at[:, None] + np.arange(size)
        text = np.searchsorted(c.first, at, "right") - 1
        return {"text": text, "start": at - c.first[text], "width": width, "size": size, "exact": exact, "template": template, "key": key, "payload": np.concatenate([_payload(c.kind[place], c.value[place]), c.opening[place].view(np.uint8)], 1)}

    for w, z in sorted(set(zip(width.tolist(), size.tolist(), strict=True))):
        at = start[(width == w) & (size == z)]
        literals = most[at + z] - most[at]
        kind = c.kind[at[:, None] + np.arange(w)]
        for i in range(w):
            # each opening both ways, but for readings that leave too few plain words
            less = literals - (kind[:, i] == LITERAL)
            also = np.flatnonzero(c.opening[at + i] & (less >= plain))
            named = kind[also]
            named[:, i] = NAME
            at, kind, literals = np.append(at, at[also]), np.concatenate([kind, named]), np.append(literals, less[also])
        value = c.value[at[:, None] + np.arange(w)]
        canon = np.where(kind == LITERAL, value, _SLOT[kind])
        template = mix(mix((canon * powers(w)).sum(1, dtype=U64)) ^ _mark(w, z, False))
        yield group(at, w, z, False, template, mix(template ^ pattern(kind, value)))
    for z in sorted(set(sizes[exact].tolist())):
        at = every[exact & (sizes == z)]
        template = mix(mix(rolling_sums(c.value, z)[at]) ^ _mark(z, z, True))
        yield group(at, z, z, True, template, template)


def _payload(kind: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Kinds and values of windows as bytes, a row each."""
    return np.concatenate([kind.view(np.uint8), np.ascontiguousarray(value).view(np.uint8).reshape(len(value), -1)], 1)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows).data)])


class Filter:
    """Shapes (width, size, exact) of item windows, and a bitmap of their templates."""

    def __init__(self, shapes: list[tuple[int, int, bool]], bits: int, blocks: dict[int, bytes]):
        self.shapes, self.bits = sorted(shapes), bits
        span = min(bits, BLOCK_BITS)
        self.seen = np.zeros(1 << (bits - 3), np.uint8)
        for block, data in blocks.items():
            self.seen[block << (span - 3) : (block + 1) << (span - 3)] = np.frombuffer(data, np.uint8)

    def places(self, template: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return template >> U64(64 - self.bits), (template * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)

    def passes(self, template: np.ndarray) -> np.ndarray:
        out = np.ones(len(template), bool)
        for place in self.places(template):
            out &= (self.seen[place >> U64(3)] >> (place & U64(7)).astype(np.uint8)) & 1 > 0
        return out

    def candidates(self, texts: list[str | None]) -> Iterator[dict]:
        """Document windows that may be an item's: text, at (canonical word), first_word, size,
        exact, key, payload."""
        c = Canonical(texts)
        n = np.diff(c.first)
        openings = _before(c.opening)
        for width, size, exact in self.shapes:
            mine = runs(c.first[:-1], np.maximum(n - size + 1, 0))
            readings = [(c.value, c.kind)] if exact else [(c.canon, c.kind), (c.canon_named, c.named)]
            for canon, kind in readings:
                template = mix(mix(rolling_sums(canon, width)[mine]) ^ _mark(width, size, exact)) if len(mine) else np.empty(0, U64)
                hit = self.passes(template)
                at, template = mine[hit], template[hit]
                if len(at):
                    short, place = at[:, None] + np.arange(width), at[:, None] + np.arange(size)
                    text = np.searchsorted(c.first, at, "right") - 1
                    key = template if exact else mix(template ^ pattern(kind[short], c.value[short]))
                    yield {"text": text, "at": at - c.first[text], "first_word": c.place[at], "size": size, "exact": exact, "key": key, "payload": _payload(kind[place], c.value[place])}
                # without an opening both readings are the same
                mine = mine[openings[mine + size] > openings[mine]]


def consistent(doc: np.ndarray, item: np.ndarray, size: int, exact: bool, plain: int) -> np.ndarray:
    """Whether pairs of windows, payloads a row each, agree: enough equal plain words and slot
    values that map one to one (an opening of the item is a name where the text has one), or,
    exact, all words equal."""
    good = np.ones(len(doc), bool)
    value = lambda rows: np.ascontiguousarray(rows[:, size : 9 * size]).view(U64)
    step = max(1, CELLS // (size * size))
    for a in range(0, len(doc), step):
        x, y = doc[a : a + step], item[a : a + step]
        u, v = value(x), value(y)
        if exact:
            good[a : a + step] = (u == v).all(1)
            continue
        kind, own, opening = x[:, :size], y[:, :size], y[:, 9 * size :] > 0
        k = np.where(opening & (kind == NAME), NAME, own)
        ok = (kind == k).all(1) & ((u == v) | (k != LITERAL)).all(1) & ((k == LITERAL).sum(1) >= plain)
        slots = (k[:, :, None] != LITERAL) & (k[:, :, None] == k[:, None, :])
        clash = ((u[:, :, None] == u[:, None, :]) != (v[:, :, None] == v[:, None, :])) & slots
        good[a : a + step] = ok & ~clash.any((1, 2))
    return good


def windows_of_items(benchmark: DataFrame, window: int, shortest: int, plain: int) -> DataFrame:
    """item_id, class (of items with the same keys), start, width, size, exact, template, key and
    payload of every window of every item that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            groups = list(item_windows(b.column(1).to_pylist(), window, shortest, plain))
            sums = np.zeros(b.num_rows, U64)
            for g in groups:
                # a set of keys: copies of one key in an item count once
                own = g["key"]
                if g["width"] < g["size"]:  # such a key does not cover its window
                    own = mix(own ^ (g["payload"] * powers(g["payload"].shape[1])).sum(1, dtype=U64))
                pairs = np.unique(np.stack([g["text"].astype(U64), own], 1), axis=0)
                np.add.at(sums, pairs[:, 0].astype(np.int64), mix(pairs[:, 1]))
            for g in groups:
                take, n = pa.array(g["text"]), len(g["text"])
                cols = [b.column(0).take(take), pa.array(sums[g["text"]].view(np.int64)), pa.array(g["start"].astype(np.int32)), pa.array(np.full(n, g["width"], np.int32)), pa.array(np.full(n, g["size"], np.int32)), pa.array(np.full(n, g["exact"])), pa.array(g["template"].view(np.int64)), pa.array(g["key"].view(np.int64)), _binary(g["payload"])]
                yield pa.RecordBatch.from_arrays(cols, names=["item_id", "class", "start", "width", "size", "exact", "template", "key", "payload"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"item_id {kind}, class long, start int, width int, size int, exact boolean, template long, key long, payload binary")


def item_classes(benchmark: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, plain: int = PLAIN) -> DataFrame:
    """item_id and class_id (the least item id with the same keys) of each item that has a window."""
    rows = windows_of_items(benchmark, window, shortest, plain).select("item_id", "class").distinct()
    return rows.join(rows.groupBy("class").agg(F.min("item_id").alias("class_id")), "class").select("item_id", "class_id")


def _filter(windows: DataFrame) -> Filter:
    """The bitmap, filled by executors block by block: the driver gets 2 ** FILTER_BITS bits at most."""
    shapes = [tuple(r) for r in windows.select("width", "size", "exact").distinct().collect()]  # a few for each size
    bits = int(np.clip(np.ceil(np.log2(16 * max(1, windows.count()))), 16, FILTER_BITS))
    span = min(bits, BLOCK_BITS)
    empty = Filter(shapes, bits, {})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = np.unique(np.concatenate(empty.places(b.column(0).to_numpy().view(U64)))).astype(np.int64)
            yield pa.record_batch({"block": (where >> span).astype(np.int32), "bit": (where & ((1 << span) - 1)).astype(np.int32)})

    def fill(part: pa.Table) -> pa.Table:
        seen = np.zeros(1 << span, np.uint8)
        seen[part.column("bit").to_numpy()] = 1
        return pa.table({"block": part.column("block")[:1], "data": pa.array([np.packbits(seen, bitorder="little").tobytes()], pa.binary())})

    rows = windows.select("template").mapInArrow(place, "block int, bit int").distinct().groupBy("block").applyInArrow(fill, "block int, data binary")
    return Filter(shapes, bits, {r["block"]: bytes(r["data"]) for r in rows.collect()})


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, plain: int = PLAIN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, item_id, n_items, n_windows and first_word: one row for each row of docs and class of
    items (its least id and its number of items) with a confirmed hit. docs: text and keep;
    benchmark: item_id, text."""
    spark = session(docs)
    windows = saved(spark, windows_of_items(benchmark, window, shortest, plain), "item-windows")
    sizes = windows.select("item_id", "class").groupBy("class").agg(F.min("item_id").alias("item_id"), F.countDistinct(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("n_items"))
    # equal in all of a class but for slot values, of which any will do
    theirs = windows.groupBy("class", "key", "size", "exact", "start").agg(F.first("payload").alias("theirs"))
    shared = spark.sparkContext.broadcast(_filter(windows))
    row = docs.select(*keep).schema

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 2):
            for g in shared.value.candidates(b.column(2).to_pylist()):
                take, n = pa.array(g["text"]), len(g["text"])
                cols = [b.column(0).take(take), b.column(1).take(take), pa.array(g["key"].view(np.int64)), pa.array(np.full(n, g["size"], np.int32)), pa.array(np.full(n, g["exact"])), pa.array(g["at"].astype(np.int32)), pa.array(g["first_word"].astype(np.int64)), _binary(g["payload"])]
                yield pa.RecordBatch.from_arrays(cols, names=["kept", "row", "key", "size", "exact", "at", "first_word", "mine"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, exact = b.column(5).to_numpy(), b.column(6).to_numpy(zero_copy_only=False)
            good = np.zeros(b.num_rows, bool)
            for size, whole in set(zip(sizes.tolist(), exact.tolist(), strict=True)):
                at = np.flatnonzero((sizes == size) & (exact == whole))
                rows = [np.frombuffer(b"".join(b.column(i).take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1) for i in (7, 8)]
                good[at] = consistent(*rows, size, whole, plain)
            yield b.filter(pa.array(good)).select([0, 1, 2, 3, 4, 9])

    head = f"kept {row.simpleString()}, row long"
    texts = docs.select(F.struct(*keep).alias("kept"), F.monotonically_increasing_id().alias("row"), F.col("text").alias("__text"))
    mine = texts.mapInArrow(look, f"{head}, key long, size int, exact boolean, at int, first_word long, mine binary")
    met = mine.join(theirs, ["key", "size", "exact"]).select("kept", "row", "at", "first_word", "class", "size", "exact", "mine", "theirs", "start")
    hits = met.mapInArrow(check, f"{head}, at int, first_word long, class long, start int")
    found = hits.groupBy("row", "class").agg(F.first("kept").alias("kept"), F.countDistinct("at", "start").alias("n_windows"), F.min("first_word").alias("first_word"))
    return found.join(sizes, "class").select(*(F.col("kept")[f.name].alias(f.name) for f in row), "item_id", "n_items", "n_windows", "first_word")
