"""Bytes that lie in long strings which occur elsewhere too, found exactly and removed.

Method: merged Burrows-Wheeler transforms (see bwt.py) give the repeated intervals of shards of text without sorting all
suffixes again. Run over a whole corpus, the merge would take a round per byte of the length asked for, over every
byte, and one merged order of everything. So the corpus is first narrowed to where equality is open:

1. Anchors: in each stretch of ``window`` bytes the least hash of eight bytes. Equal strings of the length asked for have
   their first anchor at the same place, so both hold the same bytes after it; an anchor whose following bytes occur once in the
   corpus rules out every string that has it first. (Two Bloom filters find most of these without a shuffle.)
2. Contexts: an anchor with all bytes of all strings that have it first. Where a whole context occurs twice, all its strings do.
3. What is left lies at the edges of repeated passages. It is cut to classes of strings that start within 32 bytes: all hold
   the same inner bytes, which become one symbol, with 31 bytes before and after. These short strings are
   dealt by inner bytes, shards of them are transformed and merged in 32 rounds, and blocks of two or
   more are the repeated strings.

An inner string with more than LIMIT different surroundings (a passage in a third of all documents) isn't gathered in one task:
its strings are counted one by one in a grouped aggregation instead. Contexts, inner and outer bytes are compared by 64-bit hashes, in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import merge, transform
from .common import spool
from .twice import bits_for, keep_suspected, twice_filter

#: Bytes whose hash makes an anchor; strings in a class; different surroundings that are merged in one task.
GRAM, CLASS, LIMIT = 8, 32, 512
#: Strings of a shard, and of a merge.
SHARD, MERGE = 4096, 12_288
_hash = xxhash.xxh3_64_intdigest


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _sliding(v: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """best over each window of ``width``."""
    n = len(v)
    pad = np.full(-n % width, fill, v.dtype)
    blocks = np.concatenate([v, pad]).reshape(-1, width)
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    ahead = best.accumulate(blocks, axis=1).ravel()
    return best(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: bytes, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors, and for each the first and last start of the strings of ``length`` that have it first (the leftmost, if equal)."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    for shift, by in ((8, 1), (16, 2), (32, 4)):
        x = x[:-by] | (x[by:] << np.uint64(shift))
    h = x * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    n = len(h)
    least = _sliding(h, window, np.minimum, np.iinfo(np.uint64).max)
    edge = np.zeros(window - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), window, np.maximum, 0) == h)
    value = h[at]
    # an anchor is first up to its own place, or as long as the next lower one isn't yet in the window
    runs = np.flatnonzero(np.append(True, value[1:] != value[:-1]))  # of equal hashes
    until = np.full(len(runs), n)
    until[:-1] = np.where(value[runs[1:]] < value[runs[:-1]], at[runs[1:]] - window, n)
    last = np.minimum(at, np.repeat(until, np.diff(np.append(runs, len(at)))))
    last = np.minimum(last, min(n - window, len(data) - length))
    first = np.concatenate([[0], last[:-1] + 1])
    some = first <= last
    return at[some], first[some], last[some]


class _Plan:
    def __init__(self, length: int):
        if length < 2 * CLASS + 2 * GRAM:
            raise ValueError(f"length must be at least {2 * CLASS + 2 * GRAM}")
        self.length = length
        self.window = max(CLASS, length * 5 // 8) if length * 5 // 8 + GRAM <= length else CLASS
        self.follow = length - self.window + 1

    def of(self, data: bytes) -> Iterator[tuple[int, int, int, int, int]]:
        """(anchor, first, last, key, context) of each anchor."""
        view = memoryview(data)
        for a, lo, hi in zip(*(x.tolist() for x in anchors(data, self.length, self.window)), strict=True):
            key = _signed(_hash(view[a : a + self.follow]))
            yield a, lo, hi, key, _signed(_hash(view[lo : hi + self.length], a - lo + (hi - lo << 20)))

    def classes(self, data: bytes, a: int, lo: int, hi: int) -> Iterator[tuple[int, int, int, bytes, int]]:
        """(last start, inner, outer, surroundings, bits of the starts from lo to hi) of the classes over these starts."""
        n, m = len(data), self.length
        for c in range((a - hi) // CLASS, (a - lo) // CLASS + 1):
            high = a - CLASS * c
            low = high - CLASS + 1
            if high < 0 or low + m > n:
                continue
            left, right = max(0, low), min(n, high + m)
            valid = sum(1 << i for i in range(max(0, lo - low), min(CLASS - 1, hi - low) + 1))
            inner = _signed(_hash(data[high : low + m]))
            outer = _signed(_hash(data[left:right], 1 + valid))
            yield high, inner, outer, data[left:high].rjust(CLASS - 1, b"\0") + data[low + m : right].ljust(CLASS - 1, b"\0"), valid


def merged_masks(inner: np.ndarray, around: list[bytes], n: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """For each class, a bit for each of its starts whose string occurs twice or more; ``n``: how often each class occurs."""
    group = np.unique(inner, return_inverse=True)[1]
    both = np.frombuffer(b"".join(around), np.uint8).reshape(len(around), 2 * CLASS - 2).astype(np.int64) + 1
    strings = np.concatenate([both[:, : CLASS - 1], 257 + group[:, None], both[:, CLASS - 1 :]], axis=1)
    shards = [transform(strings[i : i + SHARD], i) for i in range(0, len(strings), SHARD)]
    merged = merge(shards, CLASS)
    string, offset = np.divmod(merged.places, 2 * CLASS)
    real = offset < CLASS
    string, offset, block = string[real], offset[real], merged.block[real]
    exists = (valid[string] >> offset) & 1 > 0
    string, offset, block = string[exists], offset[exists], block[exists]
    often = np.bincount(block, n[string], merged.block[-1] + 1) >= 2
    masks = np.zeros(len(around), np.int64)
    np.bitwise_or.at(masks, string[often[block]], np.int64(1) << offset[often[block]])
    return masks


def repeated_spans(docs: DataFrame, length: int = 400, filter_bits: int | None = None) -> DataFrame:
    """(doc_id, row, spans): for documents with repeats, the starts of strings that occur elsewhere, as [first, last, first, last, ...].

    row is xxhash64 of the text; repeated rows of one doc_id and text have the same spans and one row here. filter_bits: size of
    the filters, by default by the number of anchors and of classes.
    """
    plan = _Plan(length)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    # names a document in grouping, so that no doc_id, null or repeated, gathers many texts; if two share one, they only look for each other's contexts too
    rows = rows.withColumn("did", F.xxhash64("doc_id", "row"))

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                cols: tuple[list[int], ...] = ([], [], [], [])
                for did, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found: dict[tuple[int, int], int] = {}
                    for *_, key, context in plan.of(text.encode()):
                        found[key, context] = found.get((key, context), 0) + 1
                    for (key, context), n in found.items():
                        for col, v in zip(cols, (did, key, context, n), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["did", "key", "ctx", "n"])

    every = spool(rows.select("did", "text").where(F.octet_length("text") >= length).mapInArrow(anchor_rows, "did long, key long, ctx long, n long"), "anchors")
    # a key that one document holds twice counts as seen twice
    twice = twice_filter(every.select(F.explode(F.when(F.col("n") > 1, F.array("key", "key")).otherwise(F.array("key")))), filter_bits or bits_for(every.count()))
    likely = spool(keep_suspected(every, "key", twice), "likely")
    contexts = likely.groupBy("key", "ctx").agg(F.sum("n").alias("n"), F.min("did").alias("rep"))
    contexts = spool(contexts, "contexts")
    keys = spool(contexts.groupBy("key").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("different")).where(F.col("all") > 1), "keys")
    # kind 0: the context repeats; 1: only a part may; 2: it repeats, and this document brings it as a partner for parts
    judged = contexts.join(keys, "key").select("key", "ctx", "n", "rep", "different")
    judged = spool(judged, "judged")
    listed = likely.select("did", "key", "ctx").join(judged, ["key", "ctx"])
    kind = F.when(F.col("n") == 1, 1).when((F.col("different") > 1) & (F.col("rep") == F.col("did")), 2).otherwise(0)
    listed = listed.select("did", F.struct("key", "ctx", kind.cast("int").alias("kind")).alias("c")).groupBy("did").agg(F.collect_set("c").alias("contexts"))
    found = rows.join(listed, "did").select("doc_id", "row", "text", "contexts")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                out: tuple[list, ...] = tuple([] for _ in range(9))
                for doc, row, text, listed in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                    kinds = {(c["key"], c["ctx"]): c["kind"] for c in listed}
                    data, spans, classes = text.encode(), [], []
                    for a, lo, hi, key, context in plan.of(data):
                        kind = kinds.get((key, context))
                        if kind is None:
                            continue
                        if kind != 1:
                            spans += [lo, hi]
                        if kind:
                            for high, *rest in plan.classes(data, a, lo, hi):
                                classes.append((high, *rest, 2 if kind == 2 else 1))
                    for col, v in zip(out, (doc, row, spans, None, None, None, None, None, None), strict=True):
                        col.append(v)
                    for high, inner, outer, around, valid, n in classes:
                        for col, v in zip(out, (doc, row, None, high, inner, outer, around, valid, n), strict=True):
                            col.append(v)
                kinds_of = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds_of, strict=True)], ["doc_id", "row", "spans", "high", "inner", "outer", "around", "valid", "n"])

    # equal rows bring nothing of kind 1: all their contexts occur twice
    done = spool(found.mapInArrow(judge, "doc_id long, row long, spans array<long>, high long, inner long, outer long, around binary, valid long, n long"), "judged-text")
    whole = done.where("spans is not null and size(spans) > 0").select("doc_id", "row", "spans")
    classes = done.where("spans is null")
    # inner bytes that no other class has leave nothing open
    classes = spool(keep_suspected(classes.drop("spans"), "inner", twice_filter(classes.select("inner"), filter_bits or bits_for(classes.count()))), "classes")
    outers = spool(classes.groupBy("inner", "outer").agg(F.sum("n").alias("n"), F.min("around").alias("around"), F.min("valid").alias("valid")), "outers")
    inners = spool(outers.groupBy("inner").agg(F.count(F.lit(1)).alias("different"), F.min("n").alias("least")).where("different > 1 and least = 1"), "inners")
    open_ones = spool(outers.join(inners, "inner").drop("least"), "open")
    small = open_ones.where(F.col("different") <= LIMIT).select("inner", "outer", "around", "n", "valid").repartition("inner").sortWithinPartitions("inner")

    def merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= MERGE:
                table = pa.Table.from_batches(held).combine_chunks()
                inner = table["inner"].to_numpy()
                cut = int(np.flatnonzero(np.append(True, inner[1:] != inner[:-1]))[-1])  # the last group may go on
                if cut:
                    yield from masks_of(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield from masks_of(pa.Table.from_batches(held))

    def masks_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            masks = merged_masks(table["inner"].to_numpy(), table["around"].to_pylist(), table["n"].to_numpy(), table["valid"].to_numpy())
            yield pa.RecordBatch.from_arrays([table["inner"].combine_chunks(), table["outer"].combine_chunks(), pa.array(masks)], ["inner", "outer", "mask"])

    by_merge = small.mapInArrow(merging, "inner long, outer long, mask long")
    each = open_ones.where(F.col("different") > LIMIT).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(CLASS - 1)))).where("shiftright(valid, i) & 1 = 1")
    each = each.withColumn("string", F.xxhash64("i", F.substring("around", F.col("i") + 1, F.lit(CLASS - 1))))
    each = spool(each.select("inner", "outer", "i", "string", "n"), "strings")
    often = spool(each.groupBy("inner", "string").agg(F.sum("n").alias("n")).where("n > 1").select("inner", "string"), "often")
    by_count = each.join(often, ["inner", "string"]).groupBy("inner", "outer").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
    settled = outers.where("n > 1").select("inner", "outer", F.col("valid").alias("mask"))
    masks = spool(settled.unionByName(by_merge.where("mask <> 0")).unionByName(by_count), "masks").groupBy("inner", "outer").agg(F.bit_or("mask").alias("mask"))
    parts = classes.select("doc_id", "row", "high", "inner", "outer").join(masks, ["inner", "outer"])
    starts = F.filter(F.sequence(F.col("high") - CLASS + 1, F.col("high")), lambda p: F.expr("shiftright(mask, 0)").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (p - F.col("high") + CLASS - 1).cast("int"))) != 0)
    parts = parts.select("doc_id", "row", F.flatten(F.transform(starts, lambda p: F.array(p, p))).alias("spans"))
    both = whole.unionByName(parts)
    # a set, so that the copies of a repeated row bring their spans once
    return both.groupBy("doc_id", "row").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def suffix_dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` with kept (binary), n_bytes, n_removed and n_spans, and in text what is left of it.

    Every byte covered by a string of ``length`` bytes that also starts elsewhere (another document, or elsewhere in the same one;
    overlaps count) is removed; strings are judged on the input. Null text counts as empty. Repeated rows are
    documents of their own, so long ones vanish. A null doc_id makes no difference. Where a cut goes through a character, text leaves its
    rest out and kept has it. All other columns pass through; columns named kept, n_bytes, n_removed or n_spans are replaced.
    """
    spans = repeated_spans(docs, length).select(F.col("doc_id").alias("__id"), F.col("row").alias("__r"), F.col("spans").alias("__spans"))
    full = docs.drop("kept", "n_bytes", "n_removed", "n_spans").withColumn("__row", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    full = full.join(spans, full["doc_id"].cast("long").eqNullSafe(spans["__id"]) & (full["__row"] == spans["__r"]), "left")
    others = [f for f in full.schema.fields if not f.name.startswith("__")]
    at_text, at_spans = full.columns.index("text"), full.columns.index("__spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", kept binary, n_bytes long, n_removed long, n_spans long"
    keep = [full.columns.index(f.name) for f in others]
    text_at = [f.name for f in others].index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # texts are held three times over meanwhile, so a few at a time
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            kept, sizes, gone, runs = [], [], [], []
            for text, spans in zip(batch.column(at_text).to_pylist(), batch.column(at_spans).to_pylist(), strict=True):
                data = (text or "").encode()
                left, n = without(data, spans or [], length)
                kept.append(left)
                sizes.append(len(data))
                gone.append(len(data) - len(left))
                runs.append(n)
            more = [pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs))]
            same = [batch.column(k) for k in keep]
            same[text_at] = pa.array([k.decode(errors="ignore") for k in kept], pa.string())
            yield pa.RecordBatch.from_arrays([*same, *more], [*(f.name for f in others), "kept", "n_bytes", "n_removed", "n_spans"])

    return full.mapInArrow(cut, schema)


def without(data: bytes, spans: list[int], length: int) -> tuple[bytes, int]:
    """``data`` without the bytes of the strings that start in ``spans`` ([first, last, ...]), and the number of removed runs."""
    if not spans:
        return data, 0
    at = np.array(spans, np.int64).reshape(-1, 2)
    at = at[np.argsort(at[:, 0], kind="stable")]
    ends = np.maximum.accumulate(at[:, 1] + length)
    new = np.concatenate([[True], at[1:, 0] > ends[:-1]])
    begins, ends = at[new, 0], ends[np.concatenate([new[1:], [True]])]
    kept = [data[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(data)], strict=True)]
    return b"".join(kept), len(begins)
