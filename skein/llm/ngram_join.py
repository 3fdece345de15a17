"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word shingles. J(A, B) >= t bounds the symmetric difference of two sets by
(1 - t) / (1 + t) * (|A| + |B|) and by (1 / t - 1) * min(|A|, |B|). For each size band, the shingles are dealt by hash
to one segment more than the band's largest allowed difference, and every segment holds the XOR of its shingles' codes, so two
sets within the bound agree in one segment at least (pigeonhole): each segment's value is a join key. Candidates are then
filtered by a bit sketch, in which each shingle flips one bit and whose Hamming distance cannot exceed the
difference, and verified on the sets themselves. Equal sets are one class and join once.

A key's members are compared with their first one; pairs still in different components after that are compared too,
in blocks, so no link is lost and no group lists all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.store import bound_batches, broadcast_if_small, cut, tidy
from skein.llm.textkit import Words, as_long, chunks, column, mix, release
from skein.operators.communities import components

_U = np.uint64
#: Members of a key that are compared at once after the first round.
BLOCK = 1024


class Bands:
    """Sizes from the least that can differ at all, each band half as long again as the one below; threshold in percent.

    A band has one segment more than its largest allowed difference, and `spare` ones. A segment that no shingle of a set falls into is the same in all
    sets that leave it empty, so its key would tell nothing. At most `difference` segments of two near sets differ, so at least spare + 1 agree; a set with up to
    `spare` empty segments shares a key of shingles with each partner and needs no other keys. Only sets with more empty segments than that, which the
    number of spare ones makes rare, carry keys of empty segments too, by which they meet each other.
    """

    def __init__(self, percent: int):
        if not 67 <= percent <= 99:
            raise ValueError("percent from 67 to 99: below it near sets may lie two bands apart, above it they are equal")
        self.percent, least = percent, -(-percent // (100 - percent))  # below it, near sets are equal
        edges = [least]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
        self.edges = np.array(edges)
        difference = (self.edges[1:] - 1) * (100 - percent) // percent
        self.spare = np.zeros(len(difference), np.int64)
        for _ in range(40):  # to the least number that the smallest sets of the band exceed in about one case of a thousand
            segments = difference + 1 + self.spare
            empty = segments * np.exp(-self.edges[:-1] / segments)
            self.spare = np.ceil(empty + 3 * np.sqrt(empty)).astype(np.int64)
        self.segments = difference + 1 + self.spare

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, "right") - 1


def _sets(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of the texts that have any: their indexes, sizes, first positions, and all the shingles."""
    sh, first = w.shingles(width)
    some = np.flatnonzero(np.diff(first))
    sets = [np.unique(sh[first[i] : first[i + 1]]) for i in some]
    n = np.array([len(s) for s in sets], np.int64)
    return some, n, np.cumsum(n) - n, np.concatenate(sets) if sets else np.zeros(0, _U)


def _node(n: np.ndarray, first: np.ndarray, u: np.ndarray) -> np.ndarray:
    """64 bits that stand for a whole set."""
    return mix(np.add.reduceat(mix(u ^ _U(0xA5A5A5A5)), first) ^ mix(n.astype(_U))) if len(n) else u


def _segment_keys(which: np.ndarray, band: np.ndarray, bands: Bands, n: np.ndarray, first: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets `which` in the layout of `band`, and the place in `which` of each key's set."""
    p = bands.segments[band]
    base = np.concatenate([[0], np.cumsum(p)])
    k = n[which]
    pick = u[np.repeat(first[which], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
    at = np.repeat(base[:-1], k) + (mix(pick ^ _U(0x51ED27)) % np.repeat(p, k).astype(_U)).astype(np.int64)
    acc = np.zeros(base[-1], _U)
    np.bitwise_xor.at(acc, at, mix(pick ^ _U(0xC0DEC0DE)))
    filled = np.zeros(base[-1], bool)
    filled[at] = True
    owner = np.repeat(np.arange(len(which)), p)
    empty = p - np.bincount(owner[filled], minlength=len(which))
    given = filled | (empty > bands.spare[band])[owner]
    place = np.repeat(band, p).astype(_U) << _U(40) | (np.arange(base[-1]) - np.repeat(base[:-1], p)).astype(_U)
    return mix(acc ^ mix(place))[given], owner[given]


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, node (of the set; null for an empty one), n (its size) and sketch (array<bigint>) of each row of docs (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            some, n, first, u = _sets(Words(column(batch, "text"), lower=True), width)
            size, node, valid, longs = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), np.zeros(len(batch), bool), np.zeros(len(batch), np.int64)
            size[some], node[some], valid[some] = n, as_long(_node(n, first, u)), True
            longs[some] = 1 << np.ceil(np.log2(np.maximum(n, 32) / 32)).astype(np.int64)  # a power of 2, so that a long sketch folds to a short one
            base = np.concatenate([[0], np.cumsum(longs)])
            pick = mix(u ^ _U(0xB175))
            bits = np.zeros(base[-1], _U)
            np.bitwise_xor.at(bits, np.repeat(base[some], n) + ((pick >> _U(6)) % np.repeat(longs[some], n).astype(_U)).astype(np.int64), _U(1) << (pick & _U(63)))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(node, mask=~valid), pa.array(size), pa.ListArray.from_arrays(pa.array(base.astype(np.int32)), pa.array(as_long(bits)))], names=["doc_id", "node", "n", "sketch"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node bigint, n bigint, sketch array<bigint>")


def segment_keys(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """key, node: the segments of every set's band, and of the band below for sets that have partners there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in chunks(batches):
            _, n, first, u = _sets(Words(column(batch, "text"), lower=True), width)
            node, band = as_long(_node(n, first, u)), bands.of(n)
            own = np.flatnonzero(band >= 0)
            low = own[(band[own] > 0) & (percent * n[own] <= 100 * (bands.edges[band[own]] - 1))]
            for which, where in ((own, band[own]), (low, band[low] - 1)):
                keys, owner = _segment_keys(which, where, bands, n, first, u)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(keys)), pa.array(node[which][owner])], names=["key", "node"])

    return texts.select("text").mapInArrow(run, "key bigint, node bigint")


def shingle_sets(docs: DataFrame, width: int = 3) -> DataFrame:
    """node and shingles (array<bigint>, distinct) of each text that has some."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            _, n, first, u = _sets(Words(column(batch, "text"), lower=True), width)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(_node(n, first, u))), pa.ListArray.from_arrays(pa.array(np.append(first, len(u)).astype(np.int32)), pa.array(as_long(u)))], names=["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node bigint, shingles array<bigint>")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) in order of both: (key, a: the key's first node, b: each other one). Holds one batch."""
    key, a = None, None
    for batch in batches:
        keys, nodes = column(batch, "key").to_numpy(), column(batch, "node").to_numpy()
        if not len(keys):
            continue
        new = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
        first = np.where(head >= 0, nodes[np.maximum(head, 0)], a if a is not None else 0)
        key, a = keys[-1], first[-1]
        out = first != nodes
        yield pa.RecordBatch.from_arrays([pa.array(keys[out]), pa.array(first[out]), pa.array(nodes[out])], names=["key", "a", "b"])


def _blocks(percent: int, closest: bool):
    """Rows of a block (key, i): its members, and all outsiders of the key, which meet them. Pairs in different components that the sketches let pass, or of each outsider the closest one alone."""
    def pairs(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        node, comp, n, out = (t.column(c).to_numpy() for c in ("node", "comp", "n", "outsider"))
        sketch = t.column("sketch").combine_chunks()
        size = np.diff(sketch.offsets.to_numpy())
        w, flat = int(size.min()), sketch.values.to_numpy()[sketch.offsets[0].as_py() :].view(_U)
        begin = sketch.offsets.to_numpy()[:-1] - sketch.offsets[0].as_py()
        bits = np.zeros((len(node), w), _U)
        for k in range(int(size.max()) // w):  # long sketches fold to short ones
            some = size > k * w
            bits[some] ^= flat[(begin[some] + k * w)[:, None] + np.arange(w)]
        members = np.flatnonzero(~out)
        m_node, m_comp, m_n, m_bits = node[members], comp[members], n[members], bits[members]
        out_a, out_b = [], []
        for s in np.flatnonzero(out):
            at = np.flatnonzero((m_comp != comp[s]) & (100 * np.minimum(m_n, n[s]) >= percent * np.maximum(m_n, n[s])))
            if len(at):
                far = np.bitwise_count(m_bits[at] ^ bits[s]).sum(1, dtype=np.int64)
                near = far * (100 + percent) <= (100 - percent) * (m_n[at] + n[s])
                at, far = at[near], far[near]
                if closest and len(at):
                    at = at[far.argmin()][None]
                out_a.append(np.minimum(m_node[at], node[s]))
                out_b.append(np.maximum(m_node[at], node[s]))
        flat_ = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(flat_(out_a)), pa.array(flat_(out_b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            ids = np.stack([column(batch, c).to_numpy() for c in ("key", "i")])
            cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1), len(batch)]
            if held and tuple(ids[:, 0]) != tuple(column(held[-1], c)[0].as_py() for c in ("key", "i")):
                yield pairs(held)
                held = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x:
                    yield pairs(held)
                    held = []
                held.append(batch.slice(x, y - x))
        if held:
            yield pairs(held)
        release()

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that the sketches and then the sets confirm."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), F.col("doc_id").alias(f"d{x}"))
    w = F.least(F.size("sa"), F.size("sb"))
    fold = lambda s: F.when(F.size(s) == w, F.col(s)).otherwise(F.zip_with(F.slice(s, 1, w), F.slice(s, w + 1, w), lambda x, y: x.bitwiseXOR(y)))
    far = F.aggregate(F.zip_with(fold("sa"), fold("sb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = cut(pairs.join(side("b"), "b").join(side("a"), "a").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
               .filter(far * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb", "da", "db"), "join-candidates")
    need = cut(near.select(F.col("a").alias("node"), F.col("da").alias("doc_id")).union(near.select("b", "db")).distinct(), "join-nodes")
    ids = need.select(F.col("doc_id").alias("_d")).distinct()
    texts = docs.select("doc_id", "text").join(broadcast_if_small(ids), F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    sets = cut(shingle_sets(texts, width).join(broadcast_if_small(need.select("node")), "node", "left_semi").dropDuplicates(["node"]), "join-sets")
    both = near.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a")
    shared = F.size(F.array_intersect("xa", "xb"))
    return cut(both.filter(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b"), "links")


def _open_pairs(members: DataFrame, crowd: DataFrame, comp: DataFrame, nodes: DataFrame, percent: int, closest: bool) -> DataFrame:
    """Pairs (a, b) of different components that share a key, without its first member.

    Of a key's members those outside its largest component are the outsiders. Each member lies in one block of the key; the outsiders are copied to all of
    its blocks, in parts, and meet the members there. Rows grow with members + blocks x outsiders.
    """
    inside = members.join(crowd, "key").select("key", F.col("b").alias("node"))
    inside = inside.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = inside.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy(F.col("key").alias("_k")).agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.sum("n").alias("c"), F.max("n").alias("most")).filter("c > most")
    rest = cut(inside.join(sizes, F.col("key") == F.col("_k")).select("key", "node", "comp", "c", (F.col("c") - F.col("most")).alias("o"), (F.col("comp") != F.col("largest")).alias("outsider")), "open-members")
    blocks, parts = (F.ceil(F.col(x) / BLOCK).cast("int") for x in ("c", "o"))
    here, part = F.pmod(F.hash("node"), blocks), F.pmod(F.hash("node", F.lit(1)), parts)
    as_member = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct((here * parts + p).alias("i"), F.lit(False).alias("outsider")))
    as_outsider = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct((k * parts + part).alias("i"), F.lit(True).alias("outsider")))
    places = F.when(F.col("outsider"), F.concat(as_member, as_outsider)).otherwise(as_member)
    dealt = rest.withColumn("x", F.explode(places)).join(nodes.select("node", "n", "sketch"), "node").select("key", "x.i", "x.outsider", "node", "comp", "n", "sketch")
    return dealt.repartition("key", "i").sortWithinPartitions("key", "i").mapInArrow(_blocks(percent, closest), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`; fewer than `width` words make one shingle, none an empty set
    (size 0, its own component), null text likewise. component_id is the least doc_id among all rows joined by links
    100 * |A & B| >= percent * |A | B|; repeated rows link to each other. A null doc_id is never a component_id unless a whole
    component has no other. Shingles are compared as 64-bit hashes.
    """
    bound_batches(docs.sparkSession)
    tidy(docs.sparkSession)
    table = cut(sketches(docs, width), "sketches")
    nodes = cut(table.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("c")), "nodes")
    # The texts are read again for their keys, which are many; a set's first document stands for its copies.
    copied = nodes.filter("c > 1").select("node", F.col("doc_id").alias("least"))
    extra = cut(table.select("node", "doc_id").join(broadcast_if_small(copied), "node").filter("doc_id <> least").select(F.col("doc_id").alias("id")).distinct()
                .join(nodes.select(F.col("doc_id").alias("id")), "id", "left_anti"), "copies")  # an id with another text, too, stays
    side = broadcast_if_small(extra)
    texts = docs.select("doc_id", "text")
    keyed = segment_keys(texts.join(side, texts["doc_id"] == side["id"], "left_anti"), width, percent)
    members = cut(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_stars, "key bigint, a bigint, b bigint"), "members")
    links = _verified(members.select("a", "b").distinct(), nodes, docs, width, percent)
    comp = components(links)

    # Twice each row is tried with the closest one of another component, which leaves few components; then with all of them that are left.
    crowd = members.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")  # the first member has met all
    for closest in (True, True, False):
        tidy(docs.sparkSession)
        more = cut(_open_pairs(members, crowd, comp, nodes, percent, closest), "open-pairs")
        if not more.limit(1).count():
            continue
        found = _verified(more, nodes, docs, width, percent)
        if found.limit(1).count():
            links = links.union(found)
            comp = components(links)
    least = comp.join(nodes.select("node", "doc_id"), "node").groupBy("comp").agg(F.min("doc_id").alias("least"))
    named = nodes.select("node", F.col("doc_id").alias("own_id")).join(comp.join(least, "comp").select("node", "least"), "node", "left").select("node", F.coalesce("least", "own_id").alias("least"))
    return table.select("doc_id", "n", "node").join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that name their component, with docs' columns: one document of each near-duplicate group.

    Of repeated doc_ids that name a component, one row stays. Rows of null doc_id stay unless they join a component that has an id.
    """
    found = near_duplicates(docs, width, percent)
    named = cut(found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")), "kept-ids")

    def kept(ids: DataFrame) -> DataFrame:
        side = broadcast_if_small(ids.select("id"))
        return docs.join(side, docs["doc_id"].eqNullSafe(side["id"]), "left_semi")

    once, often = named.filter("n = 1 or id is null"), named.filter("n > 1 and id is not null")
    return kept(once).unionByName(kept(often).dropDuplicates(["doc_id"])) if often.limit(1).count() else kept(once)


#: DuckDB SQL for near_duplicates() at three words and 90 percent.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS start, doc_id AS node FROM n UNION SELECT start, e.b FROM r JOIN e ON e.a = r.node), c AS (SELECT start, min(node) AS least FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.least, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.start = w.doc_id
"""
