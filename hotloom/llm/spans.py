"""Long exact spans shared between texts.

A span of at least ``length`` characters holds a full window of anchor positions, so both texts pick the same anchor in
it: the smallest of the window's hashes. Texts meet at equal anchors; around each, the windows of exactly ``length``
characters that hold it are compared, which finds every shared span and no other. Exact copies are compared once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotloom.operators.skew import BLOCK, crowded, in_every_block, in_own_block, pairs_within, split_join, with_blocks
from hotloom.session import stage

LENGTH, GRAM = 300, 100
#: Characters hashed at once; a longer text is cut into pieces that overlap by a span.
CHUNK = 1 << 20
#: An anchor with more occurrences isn't compared in one task: its windows are spread over all of them by their hash.
CROWD = 1_000
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: A second multiplier, for hashes independent of the first.
_MUL2 = np.uint64(0xBF58476D1CE4E5B9)


def _inverse(mul: np.uint64) -> np.uint64:
    return np.uint64(pow(int(mul), -1, 1 << 64))


_INV = _inverse(_MUL)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class Hasher:
    """Hashes of all windows of a text's characters; equal windows have equal hashes wherever they are."""

    def __init__(self, size: int) -> None:
        self.up, self.down = _powers(_MUL, size + 1), _powers(_INV, size + 1)

    def prefix(self, chars: np.ndarray) -> np.ndarray:
        out = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(_mix(chars.astype(np.uint64) + np.uint64(7)) * self.up[: len(chars)], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        return _mix((prefix[width:] - prefix[:-width]) * self.down[: len(prefix) - width])


def _least_at(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the position of its smallest, the leftmost of equals."""
    low = np.uint64((1 << 21) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    n = 1
    while n * 2 <= width:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    if n < width:
        m = np.minimum(m[: len(m) - (width - n)], m[width - n :])
    return (m & low).astype(np.int64)


def _pieces(texts: list[str | None], length: int, chunk: int) -> Iterator[list[tuple[int, int, str]]]:
    """Texts of at least ``length`` characters as (row, offset, piece), in groups of about ``chunk`` characters."""
    group, size = [], 0
    for row, text in enumerate(texts):
        if text is None or len(text) < length:
            continue
        for at in range(0, max(1, len(text) - length + 1), chunk - length + 1):
            piece = text[at : at + chunk]
            if size + len(piece) > chunk and group:
                yield group
                group, size = [], 0
            group.append((row, at, piece))
            size += len(piece)
    if group:
        yield group


def anchor_arrays(texts: list[str | None], length: int, gram: int, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, position, hash) of the anchors of all texts."""
    hasher, width = Hasher(chunk), length - gram + 1
    for group in _pieces(texts, length, chunk):
        chars = np.frombuffer("".join(p for _, _, p in group).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(p) for _, _, p in group])
        ends = np.cumsum(sizes)
        h = hasher.windows(hasher.prefix(chars), gram)
        least = _least_at(h, width)
        # windows that lie in one piece: they start at or before its end less the length of a span
        own = np.repeat(np.arange(len(group)), sizes)[: len(least)]
        least, own = (x[np.arange(len(least)) + length <= ends[own]] for x in (least, own))
        keep = np.ones(len(least), bool)
        keep[1:] = (least[1:] != least[:-1]) | (own[1:] != own[:-1])
        least, own = least[keep], own[keep]
        rows, offsets = np.array([r for r, _, _ in group]), np.array([o for _, o, _ in group])
        yield rows[own], least - (ends - sizes)[own] + offsets[own], h[least].view(np.int64)


def _anchorer(length: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for row, at, h in anchor_arrays(batch.column(1).to_pylist(), length, gram):
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[row]), pa.array(at.astype(np.int32))], names=["anchor", "doc", "at"])

    return anchors


def _contexts(length: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    side = length - gram

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, lists = np.asarray(batch.column(0)), batch.column(1).to_pylist(), batch.column(2)
            n = np.asarray(lists.value_lengths(), dtype=np.int64)
            flat = lists.flatten()
            at, anchor = np.asarray(flat.field("at")), flat.field("anchor")
            row = np.repeat(np.arange(len(docs)), n)
            low = np.maximum(at - side, 0)
            text = [texts[r][b : p + length] for r, b, p in zip(row.tolist(), low.tolist(), at.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([anchor, pa.array(docs[row]), pa.array(at), pa.array((at - low).astype(np.int32)), pa.array(text, pa.string())], names=["anchor", "doc", "at", "before", "context"])

    return contexts


def window_table(before: np.ndarray, contexts: list[str], length: int, gram: int, mul: np.uint64 = _MUL) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (occurrence, shift) of the windows of ``length`` characters that start side - shift before the anchor, and
    which of them lie in the text; side = length - gram. ``mul`` is an odd multiplier."""
    side = length - gram
    wide = side + length
    sizes = np.array([len(c) for c in contexts])
    chars = np.zeros((len(contexts), wide), np.uint32)
    flat = np.frombuffer("".join(contexts).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = side - before
    row = np.repeat(np.arange(len(contexts)), sizes)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[row]
    chars[row, col] = flat
    up, down = _powers(mul, wide + 1), _powers(_inverse(mul), wide + 1)
    p = np.zeros((len(contexts), wide + 1), np.uint64)
    np.cumsum(_mix(chars.astype(np.uint64) + np.uint64(7)) * up[:wide], axis=1, out=p[:, 1:])
    h = _mix((p[:, length:] - p[:, :-length]) * down[: wide - length + 1])
    shift = np.arange(side + 1)
    return h, (shift >= start[:, None]) & (shift + length <= (start + sizes)[:, None])


def _compare(anchor: np.ndarray, doc: np.ndarray, at: np.ndarray, before: np.ndarray, contexts: list[str], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (doc_a, doc_b) that share a window, and (doc, start, stop) of what is shared, of occurrences grouped by anchor."""
    side = length - gram
    h, real = window_table(before, contexts, length, gram)
    group = np.concatenate([[0], np.cumsum(anchor[1:] != anchor[:-1])])
    first, last = np.full(len(doc), side + 1), np.full(len(doc), -1)
    none = np.zeros((0, 2), np.int64)
    pairs = []
    for s in range(side + 1):
        rows = np.flatnonzero(real[:, s])
        if len(rows) < 2:
            continue
        order = rows[np.lexsort((h[rows, s], group[rows]))]
        new = np.ones(len(order), bool)
        new[1:] = (h[order[1:], s] != h[order[:-1], s]) | (group[order[1:]] != group[order[:-1]])
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        shared = np.minimum.reduceat(doc[order], starts) != np.maximum.reduceat(doc[order], starts)
        members = order[shared[run]]
        first[members] = np.minimum(first[members], s)
        last[members] = s
        if s:
            # a run whose members shared the window before, too, holds no new pair
            was = np.where(real[order, s - 1], h[order, s - 1], np.uint64(0))
            shared &= (np.minimum.reduceat(was, starts) != np.maximum.reduceat(was, starts)) | (np.minimum.reduceat(was, starts) == 0)
        order, run = order[shared[run]], run[shared[run]]
        if not len(order):
            continue
        # partners of the i-th of a run are those after it
        begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        size = np.diff(np.concatenate([begin, [len(order)]]))
        later = np.concatenate([np.arange(n - 1, -1, -1) for n in size])
        a = np.repeat(np.arange(len(order)), later)
        b = a + 1 + (np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later))
        a, b = order[a], order[b]
        fresh = doc[a] != doc[b]
        if s:
            fresh &= ~(real[a, s - 1] & real[b, s - 1] & (h[a, s - 1] == h[b, s - 1]))
        a, b = a[fresh], b[fresh]
        # the texts themselves decide
        cut = lambda x: contexts[x][before[x] - side + s : before[x] - side + s + length]  # noqa: E731, B023
        exact = np.fromiter((cut(x) == cut(y) for x, y in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
        pairs.append(np.stack([a[exact], b[exact]], axis=1))
    found = np.concatenate(pairs) if pairs else none
    ids = np.unique(np.sort(doc[found], axis=1), axis=0) if len(found) else none
    held = np.flatnonzero(last >= 0)
    return ids, np.stack([doc[held], at[held] - side + first[held], at[held] - side + last[held] + length], axis=1)


def _grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of about ``size`` rows of a stream sorted by its first column, no value in two of them."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < size:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(0).to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if cut:
            yield table.slice(0, cut)
        held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _matcher(length: int, gram: int, size: int = 4_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, size):
            columns = [table.column(i).to_numpy() for i in range(4)]
            pairs, spans = _compare(*columns, table.column(4).to_pylist(), length, gram)
            for rows, kind in ((pairs, 0), (spans, 1)):
                if len(rows):
                    third = rows[:, 2] if kind else np.zeros(len(rows), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(third)], names=["kind", "x", "y", "z"])

    return match


def _spreader(length: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2_000):
                batch = whole.slice(i, 2_000)
                at, before, contexts = np.asarray(batch.column(2)), np.asarray(batch.column(3)), batch.column(4).to_pylist()
                h, real = window_table(before, contexts, length, gram)
                g, _ = window_table(before, contexts, length, gram, _MUL2)
                row, shift = np.nonzero(real)
                start = at[row] - (length - gram) + shift
                known = (shift > 0) & real[row, shift - 1]
                was = pa.array(h[row, shift - 1].view(np.int64), mask=~known)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(shift.astype(np.int32)), pa.array(h[row, shift].view(np.int64)), pa.array(g[row, shift].view(np.int64)), batch.column(1).take(pa.array(row)), pa.array(start.astype(np.int64)), was], names=["anchor", "shift", "h", "g", "doc", "start", "was"])

    return spread


def copies(docs: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    """(doc, rep), staged: the smallest id of the documents with exactly the same text, of texts of at least ``length``."""
    long = docs.where(F.length(text) >= length).select(F.col(doc_id).cast("long").alias("doc"), F.sha2(F.col(text), 256).alias("h"))
    long = stage(long, "text_hashes")
    least = stage(long.groupBy("h").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n")).withColumnRenamed("h", "__h"), "text_reps")
    return stage(split_join(long, least, {"h": "__h"}, "n").select("doc", "rep", "n"), "copies")


def matches(docs: DataFrame, doc_id: str, text: str, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(found, same): found, staged, has (kind, x, y, z): 0 for documents x < y that share a span of at least ``length``
    characters, 1 for a stretch [y, z) of document x that lies in such spans. Of exact copies only the smallest id is in
    found; same is (doc, rep, n) of all texts long enough. Pairs are settled by comparing the texts. So are stretches,
    but those around an anchor with more than ``crowd`` occurrences, where two independent 64-bit hashes must be equal.
    """
    same = copies(docs, doc_id, text, length)
    texts = docs.where(F.length(text) >= length).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    anchors = stage(texts.mapInArrow(_anchorer(length, gram), "anchor long, doc long, at int"), "anchors")
    shared = anchors.groupBy(F.col("anchor").alias("__anchor")).agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    shared = stage(shared.where("lo < hi").select("__anchor", "n"), "shared_anchors")
    at = split_join(anchors, shared, {"anchor": "__anchor"}, "n").select("doc", F.struct("at", "anchor").alias("o"))
    at = at.groupBy("doc").agg(F.collect_list("o").alias("o"))
    other = same.where("doc <> rep").select(F.col("doc").alias("__doc"))
    at = at.join(other, at["doc"] == other["__doc"], "left_anti").withColumnRenamed("doc", "__d")
    held = texts.join(at, texts["doc"] == at["__d"]).select("doc", "text", "o")
    context = held.mapInArrow(_contexts(length, gram), "anchor long, doc long, at int, before int, context string")
    context = stage(context, "contexts")
    big = context.groupBy(F.col("anchor").alias("__anchor")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
    big = stage(big, "crowded_anchors").select("__anchor")
    few = context.join(big, context["anchor"] == big["__anchor"], "left_anti")
    result = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_matcher(length, gram), "kind int, x long, y long, z long")
    if not big.isEmpty():
        hot = context.join(big, context["anchor"] == big["__anchor"], "left_semi")
        wide = stage(hot.mapInArrow(_spreader(length, gram), "anchor long, shift int, h long, g long, doc long, start long, was long"), "crowded_windows")
        key = ["anchor", "shift", "h", "g"]
        mixed = wide.groupBy(*key).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n"), ((F.min("was") != F.max("was")) | (F.count("was") < F.count(F.lit(1)))).alias("fresh"))
        mixed = stage(mixed.where("lo < hi").withColumnsRenamed({k: f"__{k}" for k in key}), "crowded_shared")
        hit = stage(split_join(wide, mixed.select(*[f"__{k}" for k in key], "n", "fresh"), {k: f"__{k}" for k in key}, "n").select("anchor", "shift", "doc", "start", "fresh"), "crowded_hits")
        # a class whose members shared the window before, too, holds no new pair; of the others the texts themselves decide
        side = length - gram
        at = context.select(F.col("anchor").alias("__a"), F.col("doc").alias("__d"), F.col("at").alias("__at"), "before", "context")
        new = hit.where("fresh").select("anchor", "shift", "doc", (F.col("start") + side - F.col("shift")).alias("__pos"))
        new = new.join(at, (F.col("anchor") == F.col("__a")) & (F.col("doc") == F.col("__d")) & (F.col("__pos") == F.col("__at")))
        window = F.substring(F.col("context"), F.col("before") - side + F.col("shift") + 1, F.lit(length))
        members = stage(new.select("anchor", "shift", window.alias("window"), "doc").distinct(), "crowded_members")
        pairs = pairs_within(members, ["anchor", "shift", "window"], "doc").select(F.lit(0).alias("kind"), "x", "y", F.lit(0).cast("long").alias("z")).distinct()
        result = result.unionByName(pairs).unionByName(hit.select(F.lit(1).alias("kind"), F.col("doc").alias("x"), F.col("start").alias("y"), (F.col("start") + length).alias("z")).distinct())
    return stage(result, "span_matches"), same


def sharing_classes(docs: DataFrame, doc_id: str, text: str, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): what sharing_pairs lists, in a form that stays small however many copies there are. pairs (x, y)
    are between classes of exactly equal texts, each named by its smallest id; members (doc_id, class, copies, links) has
    each text of at least ``length`` characters once, with the number of its copies, itself counted, and of documents of
    other classes it shares a span with."""
    found, same = matches(docs, doc_id, text, length, gram, crowd)
    pairs = stage(found.where("kind = 0").select("x", "y").distinct(), "class_pairs")
    sizes = same.where("doc = rep").select(F.col("rep").alias("__rep"), F.col("n").alias("__n"))
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    links = both.join(sizes, F.col("y") == F.col("__rep")).groupBy("x").agg(F.sum("__n").alias("__links"))
    known = sizes.join(links, F.col("__rep") == F.col("x"), "left").select("__rep", "__n", F.coalesce("__links", F.lit(0)).alias("__links"))
    members = split_join(same.select("doc", "rep"), stage(known, "class_links"), {"rep": "__rep"}, "__n")
    return pairs, members.select(F.col("doc").alias("doc_id"), F.col("rep").alias("class"), F.col("__n").alias("copies"), F.col("__links").alias("links"))


def sharing_pairs(docs: DataFrame, doc_id: str, text: str, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents whose texts share a span of at least ``length`` characters, verbatim.

    Null and shorter texts share nothing; exact copies share if they are long enough. Document ids must be unique. The
    result grows with the square of the copies, which sharing_classes() doesn't; a class of many copies is cut into
    blocks, so no task forms more than the pairs of two.
    """
    found, same = matches(docs, doc_id, text, length, gram, crowd)
    many = same.where("n > 1").select("rep", "doc")
    within = pairs_within(many, ["rep"], "doc", block).select(F.col("x").alias("doc_id_a"), F.col("y").alias("doc_id_b"))
    crowds = crowded(same.where("doc = rep").select("rep", F.col("n").alias("__n")), "__n", ["rep"], block)
    member = in_own_block(with_blocks(same.select("rep", "doc"), crowds, {"rep": "rep"}, "__nb"), "__nb", F.col("doc"), "__own")
    units = found.where("kind = 0").select("x", "y").distinct()
    for s in "xy":
        units = in_every_block(with_blocks(units, crowds, {s: "rep"}, "__nb"), "__nb", f"block_{s}")
    for s, name in (("x", "a"), ("y", "b")):
        m = member.select(F.col("rep").alias("__rep"), F.col("doc").alias(name), "__own")
        units = units.join(m, (units[s] == m["__rep"]) & (units[f"block_{s}"] == m["__own"])).drop("__rep", "__own")
    return units.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).unionByName(within)


def coverage(docs: DataFrame, doc_id: str, text: str, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, every: bool = False) -> DataFrame:
    """(doc_id, passages, shared_chars, share) of the documents that share a span of at least ``length`` characters.

    Stretches that touch or overlap are one passage. A text that has an exact copy is one passage, shared whole. With
    ``every`` the other documents come too, null and short texts included, with 0 passages, characters and share.
    """
    found, same = matches(docs, doc_id, text, length, gram, crowd)
    size = docs.select(F.col(doc_id).cast("long").alias("__doc"), F.length(text).cast("long").alias("chars"))
    own = same.where("n = 1").select(F.col("doc").alias("__own"))
    parts = found.where("kind = 1").join(own, F.col("x") == F.col("__own"), "left_semi").select(F.col("x").alias("doc"), F.col("y").alias("start"), F.col("z").alias("stop")).distinct()
    by = Window.partitionBy("doc").orderBy("start", "stop")
    parts = parts.withColumn("reach", F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.col("reach").isNull() | (F.col("start") > F.col("reach"))
    gain = F.greatest(F.col("stop") - F.greatest(F.col("start"), F.coalesce("reach", F.col("start"))), F.lit(0))
    parts = parts.groupBy("doc").agg(F.count_if(fresh).alias("passages"), F.sum(gain).alias("shared_chars"))
    whole = same.where("n > 1").select("doc").join(size, F.col("doc") == F.col("__doc")).select("doc", F.lit(1).cast("long").alias("passages"), F.col("chars").alias("shared_chars"))
    if every:
        found = size.join(parts.unionByName(whole), F.col("doc") == F.col("__doc"), "left")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        return found.select(F.col("__doc").alias("doc_id"), zero(F.col("passages")).alias("passages"), zero(F.col("shared_chars")).alias("shared_chars"), F.coalesce(F.col("shared_chars") / F.nullif("chars", F.lit(0)), F.lit(0.0)).alias("share"))
    out = parts.unionByName(whole).join(size, F.col("doc") == F.col("__doc"))
    return out.select(F.col("doc").alias("doc_id"), "passages", "shared_chars", (F.col("shared_chars") / F.col("chars")).alias("share"))
