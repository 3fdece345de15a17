"""Near-duplicate passages by compact windows.

A text is its sequence of five-word shingles. Under a hash function, all subsequences whose least hash is that of the shingle at c
form one compact window (l, c, r): any subsequence that begins in l..c and ends in c..r. The windows are the nodes of the Cartesian tree of
the hashes, and only those of min_words or more are kept, about two per min_words. Two texts that share a passage have, under
every hash function under which the passage's two forms agree, windows with the same shingle at c, so windows join on (function, shingle);
some functions add the shingle CONTEXT places on or back to the key, which tells passages apart that merely share a frequent phrase. Of two
windows the intervals must leave room for a passage around c, and shingles sampled around c must agree.

A key's windows are paired with those of its first text, and with those of the first text that has the same four samples in a row (a neighbourhood). A pair of texts is
aligned word by word from the windows' shingles that no earlier alignment holds, and what agrees is verified: min_words or more, and a Jaccard similarity of the shingles
of `similarity` or more. Windows of a neighbourhood that lie in no verified passage may still share one with another text than those first ones: their keys' windows are
joined once more on each run of min_words words around c, which every two texts with an equal passage there have in common. Texts that are equal as a whole are one text with copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.mixing import word_count
from skein.llm.store import bound_batches, broadcast_if_small, cut, tidy
from skein.llm.textkit import Words, as_long, chunks, column, mix, release

_U = np.uint64
WIDTH, MIN_WORDS, SIMILARITY = 5, 50, 0.8
#: Hash functions that join on the shingle alone, and on it and a second one so many places away.
PLAIN, PAIRED, CONTEXT = 3, 2, 16
#: A window carries 6 bits each of the shingles so many steps from c, a step being a fifth of the least passage: two windows are paired if AGREE of them or more are the same. ROW in
#: a row are a neighbourhood: wherever c lies in a passage of min_words, ROW samples in a row lie in it, too, and span four fifths of it.
SAMPLES, AGREE, ROW = (-4, -3, -2, -1, 1, 2, 3, 4), 1, 4
#: A key is hot if HOT_SEEN windows of one text in HOT_SAMPLE have it; each of its groups is dealt to a part for every HOT_SEEN of them.
HOT_SAMPLE, HOT_SEEN = 64, 48
#: Words of either text that an alignment may skip between two stretches that agree.
GAP = 12


def cartesian_windows(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of `least` or more places. h: 64-bit hashes with a 0 before, between and after the texts.

    Nodes with that large a subtree are exactly the minima of sliding windows of `least` places, and the nearest smaller value
    of one of them is another one, so that the tree's stack runs over these alone. Of equal hashes the left one counts as less.
    """
    n = len(h)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    place = max(1, int(n - 1).bit_length())
    key = (h >> _U(place) << _U(place)) | np.arange(n, dtype=_U)
    pad = -n % least
    block = np.concatenate([key, np.full(pad, ~_U(0))]).reshape(-1, least)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[: n - least + 1], ahead[least - 1 : n])
    low = low[np.concatenate([[True], low[1:] != low[:-1]])]
    at = (low & _U((1 << place) - 1)).astype(np.int64)
    left, right = np.full(len(at), -1, np.int64), np.full(len(at), n, np.int64)
    stack: list[int] = []
    values = low.tolist()
    for i, x in enumerate(values):
        while stack and values[stack[-1]] > x:
            right[stack.pop()] = at[i]
        if stack:
            left[i] = at[stack[-1]]
        stack.append(i)
    real = h[at] > 0
    return left[real] + 1, at[real], right[real] - 1


def _repeating(who: np.ndarray, doc: np.ndarray, sh: np.ndarray, first: np.ndarray, span: int) -> np.ndarray:
    """Which windows (places `who` of their texts `doc`, in order) only shift one before them by less than `span` places through a stretch that repeats itself with just that period.

    In a run of one word, say, every place begins a window; one in `span` of them stands for all.
    """
    out = np.zeros(len(who), bool)
    if len(who) < 2:
        return out
    step = np.diff(who, prepend=who[0] - span)
    near = np.flatnonzero((step < span) & (step > 0) & np.concatenate([[False], doc[1:] == doc[:-1]]))
    near = near[sh[who[near]] == sh[who[near] - step[near]]]
    if not len(near):
        return out
    at = who[near][:, None] - np.arange(span)[None]
    back = at - step[near][:, None]
    inside = back >= first[doc[near]][:, None]
    again = (~inside | (sh[np.maximum(at, 0)] == sh[np.maximum(back, 0)])).all(1)
    out[near[again]] = True
    begin = np.maximum.accumulate(np.where(out, 0, np.arange(len(who))))  # the last window that is none
    offset = who - who[begin]
    out &= offset // span == (offset - step) // span
    return out


def windows(texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """texts: node, text. Rows key, node, c, near of all kept windows; c is the word index of the shingle's first word, near the samples around it and c - l and r - c up to 63, 6 bits each."""
    least = min_words - WIDTH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = Words(column(batch, "text"), lower=True)
            sh, first = w.shingles(WIDTH)
            number = np.diff(first)
            owner = np.repeat(np.arange(len(batch)), number)
            # One 0 before each text and one at the end.
            spot = np.arange(len(sh)) + owner + 1
            padded = np.zeros(len(sh) + len(batch) + 1, _U)
            node = column(batch, "node").to_numpy()
            for f in range(PLAIN + PAIRED):
                padded[spot] = mix(sh ^ mix(np.array([f + 1], _U))[0]) | _U(1 << 63)
                left, c, right = cartesian_windows(padded, least)
                who = np.searchsorted(spot, c)
                keep = ~_repeating(who, owner[who], sh, first, least // 2)
                left, c, right, who = (x[keep] for x in (left, c, right, who))
                doc = owner[who]
                key = mix(sh[who] + _U(f))
                if f >= PLAIN:
                    step = np.where(key & _U(1), CONTEXT, -CONTEXT)
                    other = who + step
                    inside = (other >= first[doc]) & (other < first[doc + 1])
                    key = mix(key ^ sh[np.where(inside, other, who)])
                    left, c, right, who, doc, key = (x[inside] for x in (left, c, right, who, doc, key))
                near = np.zeros(len(who), np.int64)
                for k, steps in enumerate(SAMPLES):
                    other = who + steps * max(1, (least - 1) // 5)
                    inside = (other >= first[doc]) & (other < first[doc + 1])
                    near |= np.where(inside, (sh[np.where(inside, other, 0)] % _U(63)).astype(np.int64) + 1, 0) << (6 * k)
                near |= np.minimum(c - left, 63) << 48 | np.minimum(right - c, 63) << 54
                shift = first[doc] + doc + 1
                yield pa.RecordBatch.from_arrays([pa.array(as_long(key)), pa.array(node[doc]), pa.array((c - shift).astype(np.int32)), pa.array(near)], names=["key", "node", "c", "near"])

    return texts.select("node", "text").mapInArrow(run, "key bigint, node bigint, c int, near bigint")


def _sample(near: np.ndarray, k: int) -> np.ndarray:
    return near >> (6 * k) & 63


def _agree(x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """The interval join: whether windows x and y have room for a common passage of `least` shingles less a fifth, and AGREE samples in common."""
    room = np.minimum(_sample(x, 8), _sample(y, 8)) + np.minimum(_sample(x, 9), _sample(y, 9)) + 1
    same = sum(((_sample(x, k) == _sample(y, k)) & (_sample(x, k) > 0)).astype(np.int8) for k in range(len(SAMPLES)))
    return (room >= min(least * 4 // 5, 60)) & (same >= AGREE)


def _rows(near: np.ndarray) -> list[np.ndarray]:
    """The neighbourhoods: each run of ROW samples as one number, 0 where the text does not hold all of them."""
    return [np.where(np.all([_sample(near, k + j) > 0 for j in range(ROW)], axis=0), (near >> (6 * k) & ((1 << 6 * ROW) - 1)) << 3 | k, 0) for k in range(len(SAMPLES) - ROW + 1)]


_PAIRS = "key bigint, a bigint, ac int, anear bigint, b bigint, bc int, near bigint, met boolean, amask int, mask int, u bigint"


def _stars(least: int):
    """Windows in order of g, node, c: each with the first one of its g and with the first one of each of its neighbourhoods.

    A row per window and partner: (a, ac) the partner, (b, bc) the window; met: they are of two texts and agree; mask, amask: bits of the neighbourhoods of b, of a, that have two texts. What
    has none of these is left out. Holds a batch, and the first windows of one group's neighbourhoods.

    Of hot keys (bit not null), a g is a part of one neighbourhood (bit: which; 0: of the whole key) named u: windows meet the part's first alone, which comes as a row of its own with u.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, {}  # the group that the batch before ended in: its first windows by neighbourhood, 0 being the whole group
        names, names_out = ("node", "c", "near"), ["key", "a", "ac", "anear", "b", "bc", "near", "met", "amask", "mask", "u"]
        held: pa.RecordBatch | None = None  # the last row, whose group may or may not go on

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal last, kept
            g, cols = column(batch, "g").to_numpy(), [column(batch, x).to_numpy() for x in names]
            n = len(g)
            begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            head = np.repeat(begins, np.diff(np.append(begins, n)))
            old = {} if last is None or g[0] != last else kept
            first_end = begins[1] if len(begins) > 1 else n
            kinds = [np.zeros(n, np.int64), *_rows(cols[2])]
            partner, partners = [], []
            for kind in kinds:
                at = np.flatnonzero((kind > 0) if kind is not kinds[0] else np.ones(n, bool))
                one = np.full(n, -1, np.int64)
                if len(at):
                    _, inv_first, inv = np.unique(mix(head[at].astype(_U) + mix(kind[at].astype(_U))), return_index=True, return_inverse=True)
                    one[at] = at[inv_first[inv]]
                values = [np.where(one >= 0, x[np.maximum(one, 0)], 0) for x in cols]
                if old:
                    for i in at[at < first_end]:
                        if (o := old.get(int(kind[i]))) is not None:
                            for v, x in zip(values, o, strict=True):
                                v[i] = x
                            one[i] = n  # an earlier batch's
                partner.append(one)
                partners.append(values)
            tail = begins[-1]
            if last is None or g[-1] != last:
                kept = {}
            last = g[-1]
            for kind, one in zip(kinds, partner, strict=True):
                for i in np.flatnonzero((one[tail:] == np.arange(tail, n))) + tail:
                    kept.setdefault(int(kind[i]), tuple(int(x[i]) for x in cols))
            mask = np.zeros(n, np.int32)
            others = [(one >= 0) & (pn != cols[0]) for one, (pn, _, _) in zip(partner, partners, strict=True)]
            for k, (one, other) in enumerate(zip(partner[1:], others[1:], strict=True)):
                mask[other] |= 1 << k
                np.bitwise_or.at(mask, one[other & (one < n)], 1 << k)
            out, key = [], column(batch, "key").to_numpy()
            seen: list[np.ndarray] = []
            for k, (one, other, (pn, pc_, pnear)) in enumerate(zip(partner, others, partners, strict=True)):
                met = other & _agree(pnear, cols[2], least)
                for x in seen:
                    met &= x != pn
                seen.append(np.where(met, pn, cols[0]))
                early = other & (one == n) if k else np.zeros(n, bool)  # the partner's own row is out already
                take = np.flatnonzero(met | early if k else met | (mask > 0))
                out.append([key[take], pn[take], pc_[take], pnear[take], cols[0][take], cols[1][take], cols[2][take], met[take], np.where(early[take], 1 << max(k - 1, 0), 0).astype(np.int32), mask[take]])
            arrays = [np.concatenate(x) for x in zip(*out, strict=True)]
            arrays[2], arrays[5] = arrays[2].astype(np.int32), arrays[5].astype(np.int32)
            return pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.nulls(len(arrays[0]), pa.int64())], names=names_out)

        top: tuple | None = None  # the first window of the hot group that the batch before ended in

        def hot(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal top
            g, (key, u, bit, *cols) = column(batch, "g").to_numpy(), [column(batch, x).to_numpy() for x in ("key", "u", "bit", *names)]
            new = np.concatenate([[top is None or g[0] != top[0]], g[1:] != g[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
            first = [np.where(at >= 0, x[np.maximum(at, 0)], h) for x, h in zip(cols, top[1:] if top else (0, 0, 0), strict=True)]
            top = (g[-1], *(x[-1] for x in first))
            other = first[0] != cols[0]
            met, bits = other & _agree(first[2], cols[2], least), np.where(other, bit, 0).astype(np.int32)
            take = new | met | (bits > 0)
            arrays = [key, first[0], first[1].astype(np.int32), first[2], cols[0], cols[1].astype(np.int32), cols[2], met, bits, np.where(new, bit, bits).astype(np.int32)]
            return pa.RecordBatch.from_arrays([*[pa.array(x[take]) for x in arrays], pa.array(u[take], mask=~new[take])], names=names_out)

        for batch in batches:
            frequent = column(batch, "bit").is_valid()
            if pc.any(frequent).as_py():
                yield hot(batch.filter(frequent))
                batch = batch.filter(pc.invert(frequent))
            if not len(batch):
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            g = column(batch, "g").to_numpy()
            alone = np.concatenate([[last is None or g[0] != last], g[1:] != g[:-1]]) & np.concatenate([g[1:] != g[:-1], [False]])
            some = batch.filter(pa.array(~alone)) if alone.any() else batch
            held = some.slice(len(some) - 1)
            if len(some) > 1:
                yield work(some.slice(0, len(some) - 1))
        if held is not None and len(held) and last is not None and column(held, "g")[0].as_py() == last:
            yield work(held)
        release()

    return run


def _paired(found: DataFrame, least: int) -> DataFrame:
    """found: windows with g (group), key, u and bit. The stars of each group."""
    return found.select("g", "key", "node", "c", "near", "u", "bit").repartition("g").sortWithinPartitions("g", "node", "c").mapInArrow(_stars(least), _PAIRS)


def _hot_keys(texts: DataFrame, min_words: int) -> DataFrame:
    """Keys that a sample of the texts shows to be frequent, and the parts that they are dealt to."""
    some = texts.filter(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(HOT_SAMPLE)) == 0)
    seen = windows(some, min_words).groupBy(F.col("key").alias("hot")).agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_SEEN)
    return cut(seen.select("hot", F.ceil(F.col("n") / HOT_SEEN).cast("int").alias("parts")), "hot-keys")


def _neighbourhoods() -> list[Column]:
    """Hashes of key and neighbourhood of a window (key, near), null where the text does not hold all of its samples."""
    sample = lambda k: F.shiftright("near", 6 * k).bitwiseAND(F.lit(63))
    return [F.when(F.least(*[sample(k + j) for j in range(ROW)]) > 0, F.xxhash64("key", F.lit(k), F.shiftright("near", 6 * k).bitwiseAND(F.lit((1 << 6 * ROW) - 1)))) for k in range(len(SAMPLES) - ROW + 1)]


def _candidates(texts: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of windows (a, ac, b, bc) to be aligned, and the windows of neighbourhoods of two texts or more (key, node, c, near, mask).

    A hot key and each of its neighbourhoods are groups dealt to parts by text: windows meet their part's first one, and those the group's first one.
    """
    least = min_words - WIDTH + 1
    hot = _hot_keys(texts, min_words)
    all_ = windows(texts, min_words)
    if hot.limit(1).count():
        marked = all_.join(broadcast_if_small(hot), F.col("key") == F.col("hot"), "left")
        group = lambda u, bit: F.struct(u.alias("u"), F.lit(bit).alias("bit"))
        groups = F.when(F.col("hot").isNotNull(), F.array_compact(F.array(group(F.col("key"), 0), *[F.when(u.isNotNull(), group(u, 1 << k)) for k, u in enumerate(_neighbourhoods())])))
        each = marked.select("key", "node", "c", "near", "parts", F.explode(F.coalesce(groups, F.array(F.struct(F.lit(None).cast("bigint").alias("u"), F.lit(None).cast("int").alias("bit"))))).alias("x")).select("*", "x.*")
        dealt = each.withColumn("g", F.when(F.col("bit").isNull(), F.col("key")).otherwise(F.xxhash64("u", F.pmod(F.hash("node"), F.col("parts")))))
        found = cut(_paired(dealt, least), "passage-windows")
        tops = found.filter("u is not null").select("key", F.col("b").alias("node"), F.col("bc").alias("c"), "near", "u", F.col("mask").alias("bit"), F.col("u").alias("g"))
        found = found.withColumn("mask", F.when(F.col("u").isNull(), F.col("mask")).otherwise(0)).unionByName(_paired(tops, least).withColumn("mask", F.when(F.col("u").isNull(), F.col("mask")).otherwise(0)))
    else:
        found = cut(_paired(all_.withColumn("g", F.col("key")).withColumn("u", F.lit(None).cast("bigint")).withColumn("bit", F.lit(None).cast("int")), least), "passage-windows")
    one = lambda n, c, near, mask: found.filter(F.col(mask) > 0).select("key", F.col(n).alias("node"), F.col(c).alias("c"), F.col(near).alias("near"), F.col(mask).alias("mask"))
    rows = one("b", "bc", "near", "mask").union(one("a", "ac", "anear", "amask")).groupBy("key", "node", "c", "near").agg(F.bit_or("mask").alias("mask"))
    return found.filter("met").select("a", "ac", "b", "bc"), rows


def _outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with their text's verified passages, spans: whether their shingle at c lies in none."""
    for batch in batches:
        c, at = column(batch, "c").to_numpy(), column(batch, "spans")
        size = pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, who = at.flatten(), np.repeat(np.arange(len(c)), size)
        hit = (flat.field("begin").to_numpy() <= c[who]) & (c[who] + WIDTH <= flat.field("end").to_numpy())
        out = np.ones(len(c), bool)
        out[who[hit]] = False
        yield pa.RecordBatch.from_arrays([*[column(batch, x) for x in ("key", "node", "c", "near", "mask")], pa.array(out)], names=["key", "node", "c", "near", "mask", "outside"])


def _needed(least: int) -> np.ndarray:
    """Bits of the neighbourhoods that a passage of `least` shingles holds whose begin lies so many places before c."""
    step, p = max(1, (least - 1) // 5), np.arange(least)
    left, right = np.minimum(p // step, ROW), np.minimum((least - 1 - p) // step, ROW)
    return np.array([sum(1 << k for k in range(ROW - x, y + 1)) for x, y in zip(left, right, strict=True)])


def _word_runs(min_words: int):
    """Texts with places (c and a mask of neighbourhoods): (g: hash of a run of min_words words, node, c: its begin) of each run around a place that lies in such neighbourhoods alone."""
    least = min_words - WIDTH + 1
    need = _needed(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = Words(column(batch, "text"), lower=True)
            sh, first = w.shingles(WIDTH)
            places, node = column(batch, "places"), column(batch, "node").to_numpy()
            out_g, out_node, out_c = [], [], []
            for i in range(len(batch)):
                s, at = sh[first[i] : first[i + 1]], places[i].values
                c, mask = at.field("c").to_numpy(), at.field("mask").to_numpy()
                fits = (mask[:, None] & need[None]) == need[None]
                begins = np.unique((c[:, None] - np.arange(least)[None])[fits])
                begins = begins[(begins >= 0) & (begins + least <= len(s))]
                if len(begins):
                    h = np.zeros(len(begins), _U)
                    for k in range(least):
                        h = mix(h * _U(0x9E3779B97F4A7C55) + s[begins + k])
                    out_g.append(h)
                    out_node.append(np.full(len(begins), node[i]))
                    out_c.append(begins.astype(np.int32))
            if out_g:
                yield pa.RecordBatch.from_arrays([pa.array(as_long(np.concatenate(out_g))), pa.array(np.concatenate(out_node)), pa.array(np.concatenate(out_c))], names=["g", "node", "c"])

    return run


def _left_over(texts: DataFrame, rows: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """a, ac, b, bc: of the neighbourhoods that have windows outside all passages of `found`, equal runs of min_words words around their windows, each paired with the first text that has it."""
    span = lambda x: found.select(F.col(x).alias("node"), F.struct(F.col(f"{x}_begin").alias("begin"), F.col(f"{x}_end").alias("end")).alias("s"))
    spans = span("a").union(span("b")).groupBy("node").agg(F.collect_set("s").alias("spans"))
    told = cut(rows.join(spans, "node", "left").select("key", "node", "c", "near", "mask", "spans").mapInArrow(_outside, "key bigint, node bigint, c int, near bigint, mask int, outside boolean"), "passage-rows")
    each = told.withColumn("x", F.explode(F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) > 0, F.struct(u.alias("u"), F.lit(1 << k).alias("bit"))) for k, u in enumerate(_neighbourhoods())])))).select("node", "c", "outside", "x.u", "x.bit")
    open_ = cut(each.filter("outside").select("u").distinct(), "passage-open")
    near = each.join(broadcast_if_small(open_), "u", "left_semi").groupBy("node", "c").agg(F.bit_or("bit").alias("mask"))
    places = cut(near.groupBy("node").agg(F.collect_list(F.struct("c", "mask")).alias("places")), "passage-places")
    side = broadcast_if_small(places.select("node"))
    some = texts.join(side, "node", "left_semi").select("node", "text").join(places, "node")
    runs = cut(some.select("node", "text", "places").mapInArrow(_word_runs(min_words), "g bigint, node bigint, c int"), "passage-runs")
    heads = runs.groupBy("g").agg(F.min(F.struct("node", "c")).alias("head"), F.max("node").alias("top"))
    heads = heads.filter("head.node <> top").select(F.col("g").alias("_g"), F.col("head.node").alias("a"), F.col("head.c").alias("ac"))
    pairs = runs.join(heads, F.col("g") == F.col("_g")).filter("node <> a").select("a", "ac", F.col("node").alias("b"), F.col("c").alias("bc"))
    # Of runs that follow each other on a diagonal the first stands for all.
    before = F.lag("bc").over(Window.partitionBy("a", "b", F.col("bc") - F.col("ac")).orderBy("bc"))
    return cut(pairs.withColumn("before", before).filter("before is null or before < bc - 1").select("a", "ac", "b", "bc"), "passage-left-over")


def _run(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        differ = (x[at : at + step] != y[at : at + step]) if at + step <= n else (x[at:n] != y[at:n])
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = at + step, step * 4
    return n


def _grams(words: np.ndarray) -> np.ndarray:
    """64-bit codes of all runs of WIDTH words."""
    n, wide = max(len(words) - WIDTH + 1, 0), mix(words.astype(_U))
    acc = wide[:n].copy()
    for k in range(1, WIDTH):
        acc *= _U(0x9E3779B97F4A7C15)
        acc += wide[k : k + n]
    return acc


def _stretches(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, i: int, j: int) -> list[tuple[int, int, int]]:
    """Stretches (place in a, place in b, length) that agree, from (i, j) on, with at most GAP words of either text skipped between them. ga, gb: the texts' grams."""
    out = []
    while True:
        n = _run(a[i:], b[j:])
        if n:
            out.append((i, j, n))
        i, j = i + n, j + n
        x, y = ga[i : i + GAP + 1], gb[j : j + GAP + 1]
        if not len(x) or not len(y):
            return out
        same = x[:, None] == y
        if not same.any():
            return out
        p, q = np.nonzero(same)
        best = int((p + q).argmin())
        i, j = i + int(p[best]), j + int(q[best])


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of grams."""
    x, y = np.unique(a), np.unique(b)
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return both / (len(x) + len(y) - both)


def _best(ga: np.ndarray, gb: np.ndarray, parts: list[tuple[int, int, int]], min_words: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """The longest range of stretches that is a near-duplicate passage, and those of what is left on both sides of it.

    A range from stretch s to e has agree[e] - agree[s - 1] shingles in common and so many words on either side; that it is similar enough is an inequality of a term of e and one of s, so
    the last e for each s is found in the running maxima from behind.
    """
    i, j, n = np.array(parts, np.int64).reshape(-1, 3).T
    before = np.concatenate([[0], np.cumsum(np.maximum(n - WIDTH + 1, 0))])
    ends = (1 + similarity) * before[1:] - similarity * (i + j + 2 * n - 2 * (WIDTH - 1)) + 1e-9
    begins = (1 + similarity) * before[:-1] - similarity * (i + j)
    out, todo = [], [(0, len(parts))]
    while todo:
        lo, hi = todo.pop()
        if lo >= hi or i[hi - 1] + n[hi - 1] - i[lo] < min_words or j[hi - 1] + n[hi - 1] - j[lo] < min_words:
            continue
        behind = np.maximum.accumulate(ends[lo:hi][::-1])  # behind[k]: the greatest of the last k + 1
        last = hi - 1 - np.searchsorted(behind, begins[lo:hi])
        ok = last >= np.arange(lo, hi)
        e = np.maximum(last, lo)
        wa, wb = i[e] + n[e] - i[lo:hi], j[e] + n[e] - j[lo:hi]
        wb = np.where(ok & (np.minimum(wa, wb) >= min_words), wb, -1)
        k = int(wb.argmax())
        if wb[k] < 0:
            continue
        s, e = lo + k, int(e[k])
        a0, a1, b0, b1 = int(i[s]), int(i[e] + n[e]), int(j[s]), int(j[e] + n[e])
        alike = 1.0 if s == e else _jaccard(ga[a0 : a1 - WIDTH + 1], gb[b0 : b1 - WIDTH + 1])
        if alike >= similarity:
            out.append((a0, a1, b0, b1, alike))
        todo += [(lo, s), (e + 1, hi)]
    return out


def passages(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int]], min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """Verified passages (begin and end in a, in b, similarity) of two word sequences from anchors (place in a, in b) of equal shingles.

    An anchor is left out if an alignment has its diagonal there already, or if its shingle of b lies in a passage and the words that agree around it add less than half of min_words to
    what passages cover of b; so a text that repeats itself is covered, but not once for each way to shift it.
    """
    out: list[tuple[int, int, int, int, float]] = []
    ga, gb = _grams(a), _grams(b)
    at = np.array(anchors, np.int64).reshape(-1, 2)
    at = at[(at[:, 0] < len(ga)) & (at[:, 1] < len(gb))]
    at = at[ga[at[:, 0]] == gb[at[:, 1]]]
    aligned: dict[int, list[tuple[int, int]]] = {}  # by diagonal, the stretches of a
    covered = np.zeros(len(b), bool)
    for i, j in at[np.lexsort((at[:, 0], at[:, 1]))].tolist():
        if any(p <= i < q for p, q in aligned.get(i - j, ())):
            continue
        if covered[j : j + WIDTH].all():
            begin, end = j - _run(a[:i][::-1], b[:j][::-1]), j + _run(a[i:], b[j:])
            if 2 * (end - begin - np.count_nonzero(covered[begin:end])) < min_words:
                continue
        parts = [(i - p - n, j - q - n, n) for p, q, n in reversed(_stretches(a[:i][::-1], b[:j][::-1], ga[: max(i - WIDTH + 1, 0)][::-1], gb[: max(j - WIDTH + 1, 0)][::-1], 0, 0))]
        ahead = _stretches(a, b, ga, gb, i, j)
        if parts and parts[-1][0] + parts[-1][2] == i and parts[-1][1] + parts[-1][2] == j:
            p, q, n = parts.pop()
            ahead[0] = (p, q, n + ahead[0][2])
        parts += ahead
        for p, q, n in parts:
            aligned.setdefault(p - q, []).append((p, p + n))
        for x in _best(ga, gb, parts, min_words, similarity):
            out.append(x)
            covered[x[2] : x[3]] = True
    return sorted(set(out), key=lambda x: (x[2], x[3], x[0]))


def _verify(min_words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            at = column(batch, "anchors")
            ends, flat = at.offsets.to_numpy(), at.values
            every = np.stack([flat.field("ac").to_numpy(), flat.field("bc").to_numpy()], 1).astype(np.int64)
            nodes_a, nodes_b, skips = (column(batch, c).to_pylist() for c in ("a", "b", "skip"))
            for r, (wa, wb) in enumerate(zip(column(batch, "wa"), column(batch, "wb"), strict=True)):
                a, b, skip = np.frombuffer(wa.as_buffer(), np.uint32), np.frombuffer(wb.as_buffer(), np.uint32), skips[r]
                anchors = every[ends[r] : ends[r + 1]] - (skip, 0)
                out += [(nodes_a[r], nodes_b[r], p[0] + skip, p[1] + skip, *p[2:]) for p in passages(a, b, anchors, min_words, similarity)]
            names = ["a", "b", "a_begin", "a_end", "b_begin", "b_end", "similarity"]
            types = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names=names)
        release()

    return run


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        w = Words(column(batch, "text"), lower=True)
        yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array([(w.hash[x:y] >> _U(32)).astype(np.uint32).tobytes() for x, y in zip(w.first[:-1], w.first[1:], strict=True)], pa.binary())], names=["node", "words"])


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """docs with node; per text node, least doc_id and number of rows; the rows that repeat a text (node, doc_id, first, n_words); whether rows repeat a text and its least doc_id."""
    keyed = docs.select("doc_id", "text").filter("text is not null").withColumn("node", F.xxhash64("text"))
    table = cut(keyed.select("doc_id", "node"), "passage-texts")
    classes = cut(table.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")), "passage-classes")
    many = broadcast_if_small(classes.filter("c > 1"))
    sizes = keyed.join(many.select(F.col("node").alias("_n"), "first"), (F.col("node") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("node").agg(F.first(word_count("text")).alias("n_words"))
    copies = cut(table.join(many, "node").filter("doc_id <> first").join(sizes, "node").select("node", "doc_id", "first", "n_words"), "passage-copies")
    again = table.join(many, "node").filter("doc_id is null or doc_id = first").groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() > 0
    return keyed, classes, copies, again


def _passages(texts: DataFrame, candidates: DataFrame, again: bool, min_words: int, similarity: float) -> DataFrame:
    """The verified passages of candidates (a, ac, b, bc)."""
    pairs = cut(candidates.groupBy("a", "b").agg(F.collect_set(F.struct("ac", "bc")).alias("anchors")), "passage-pairs")
    nodes = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "passage-nodes")
    words = texts.join(broadcast_if_small(nodes), "node", "left_semi").select("node", "text").mapInArrow(_word_hashes, "node bigint, words binary")
    words = cut(words.dropDuplicates(["node"]) if again else words, "passage-words")
    both = pairs.join(words.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b").join(words.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a")
    # Between two stretches of WIDTH words or more an alignment skips GAP words at most, so it takes up no more of a than this for each word of b.
    reach = F.length("wb") / 4 * ((GAP + WIDTH) / WIDTH) + 64
    lowest = F.greatest(F.lit(0), F.array_min(F.transform("anchors", lambda x: x["ac"])) - reach).cast("int")
    size = (F.array_max(F.transform("anchors", lambda x: x["ac"])) + reach - lowest).cast("int")
    both = both.withColumn("skip", lowest).withColumn("wa", F.substring("wa", 4 * F.col("skip") + 1, 4 * size))
    out = both.select("a", "b", "anchors", "skip", "wa", "wb").mapInArrow(_verify(min_words, similarity), "a bigint, b bigint, a_begin int, a_end int, b_begin int, b_end int, similarity double")
    return cut(out, "passages")


def shared_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, classes, copies) of docs (doc_id, text).

    pairs: a, b (nodes), a_begin, a_end, b_begin, b_end (word indexes, end excluded), similarity: the passage of b repeats one of a; the
    first text in order of node keeps a passage. A passage repeated within one text alone is none. Null and short texts have none.
    """
    bound_batches(docs.sparkSession)
    tidy(docs.sparkSession)
    keyed, classes, copies, again = _classes(docs)
    extra = broadcast_if_small(copies.select("doc_id", "node").distinct())
    texts = keyed.join(extra, (keyed["doc_id"] == extra["doc_id"]) & (keyed["node"] == extra["node"]), "left_anti")
    candidates, rows = _candidates(texts, min_words)
    out = _passages(texts, candidates, again, min_words, similarity)
    tidy(docs.sparkSession)
    more = _left_over(texts, rows, out, min_words)
    if more.limit(1).count():
        out = out.union(_passages(texts, more, again, min_words, similarity)).distinct()
    return out, classes, copies


def report(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per repeated passage: doc_id, begin, end (word indexes), first_doc_id, first_begin, first_end, similarity.

    A row that repeats a whole text of min_words or more stands for it with similarity 1; the other passages are given for one row of each text.
    """
    pairs, classes, copies = shared_passages(docs, min_words, similarity)
    name = lambda x, d: classes.select(F.col("node").alias(x), F.col("first").alias(d))
    near = pairs.join(name("b", "doc_id"), "b").join(name("a", "first_doc_id"), "a")
    whole = copies.filter(F.col("n_words") >= min_words).select("doc_id", F.lit(0).alias("begin"), F.col("n_words").cast("int").alias("end"), F.col("first").alias("first_doc_id"), F.lit(0).alias("first_begin"), F.col("n_words").cast("int").alias("first_end"), F.lit(1.0).alias("similarity"))
    return near.select("doc_id", F.col("b_begin").alias("begin"), F.col("b_end").alias("end"), "first_doc_id", F.col("a_begin").alias("first_begin"), F.col("a_end").alias("first_end"), "similarity").unionByName(whole)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        w = Words(column(batch, "text"))
        raw = np.frombuffer(w.raw, np.uint8)
        new = column(batch, "text").to_pylist()
        for i, spans in enumerate(column(batch, "spans").to_pylist()):
            if spans:
                keep = np.ones(int(w.offsets[i + 1] - w.offsets[i]), bool)
                starts = np.append(w.start[w.first[i] : w.first[i + 1]], w.offsets[i + 1]) - w.offsets[i]
                for s in spans:
                    keep[starts[s["b_begin"]] : starts[s["b_end"]]] = False
                new[i] = raw[w.offsets[i] : w.offsets[i + 1]][keep].tobytes().decode()
        names = [c for c in batch.schema.names if c != "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else column(batch, c) for c in names], names=names)


def remove_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with every repeated passage cut out of all texts but the first that has it; a row of which nothing is left goes.

    Rows without text, short texts and texts without a shared passage come out as they are.
    """
    pairs, _, copies = shared_passages(docs, min_words, similarity)
    spans = cut(pairs.groupBy(F.col("b").alias("node")).agg(F.collect_set(F.struct("b_begin", "b_end")).alias("spans")), "passage-spans")
    copied = broadcast_if_small(copies.filter(F.col("n_words") >= min_words).select("doc_id", "node").distinct())
    node = F.xxhash64(docs["text"])
    rest = docs.join(copied, (docs["doc_id"] == copied["doc_id"]) & (node == copied["node"]), "left_anti")
    rows = rest.select(F.struct(*docs.columns).alias("row"), "text")  # so names of docs cannot clash
    side = broadcast_if_small(spans, 100_000)
    cuts = rows.join(side, F.xxhash64("text") == side["node"], "left").select("row", "text", "spans", F.col("spans").isNotNull().alias("had"))
    done = cuts.mapInArrow(_cut_out, cuts.drop("spans").schema).filter("not had or trim(text) <> ''")
    return done.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
