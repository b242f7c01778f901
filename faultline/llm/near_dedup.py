r"""Operator 5, near-duplicates by b-bit MinHash: bands of minima give candidates, packed low bits estimate their similarity, full sets decide.

Each distinct shingle set is one node, so copies never meet in pairs. ``BANDS`` bands of ``ROWS`` minima put two sets of
similarity 0.85 into a common bucket but for about 7 in 10^9 pairs. In a bucket every member is compared with one
centre, not with all: a candidate goes on to the full sets unless the estimate from its ``BITS``-bit signature, corrected
for chance agreement, is ``SLACK`` below the threshold (five standard deviations). Members that end in another component
than some other member get a next centre in the same way, ``turns`` times.

What is then still divided is decided exactly and without comparing all pairs. Members of a bucket have its first centre in common and are
written as their differences from it; two members share |c| - |missing of x| - |missing of y| + |common differences|
shingles, so a link asks for a number of common differences that their sizes give. Differences are ordered by how few
members have them, and a pair that has enough in common meets within the first ones of both (prefix filtering). Unlinked
copies of one text differ from it in ways of their own, so they hardly ever meet.

Sets are 64-bit hashes of shingles; links are decided on them in full. Components are labelled by star contraction on
written tables; nothing is gathered to the driver but counts.

Words are ``[^\x20\x09-\x0D]+`` of the text with A-Z lower-cased. Null, empty and blank texts have no shingles and link
with nothing. Rows of one id are one document, whose links are those of all its texts; ``n_shingles`` is that of the row.
Rows with a null id are nobody's copy: their component and ``kept`` are null and true. Ties in a component go to its
smallest id. Ids are of any type that has an order. Empty tables give no rows; extra columns are not read. A text's set and
the minima in blocks bound memory, so the longest text does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import Scratch, components, mix, salted, slices, span_hashes, table, text_column, word_spans

BANDS, ROWS, BITS, SLACK = 32, 5, 4, 0.15
_PERMUTATIONS = BANDS * ROWS
_RNG = np.random.Generator(np.random.PCG64(5))
_A = _RNG.integers(0, 1 << 31, _PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, _PERMUTATIONS, dtype=np.uint32)
_FOLD = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text of a slice its sorted distinct shingle hashes."""
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    h = span_hashes(data, starts, ends)
    rolled = mix(h)
    for k in range(1, width):
        rolled[: len(h) - k] = mix(rolled[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if n >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif n:  # the whole sequence as one
            x = mix(h[a : a + 1])
            for k in range(1, n):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[a + k])
            yield mix(x + np.uint64(n))
        else:
            yield h[:0]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a set; in blocks that stay in the cache."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(_PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(out, (x[k : k + 512, None] * _A + _B).min(axis=0), out=out)
    return out


def _set_hash(shingles: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix(np.array([mix(shingles ^ np.uint64(k)).sum(dtype=np.uint64) + np.uint64(len(shingles))]))[0].astype(np.int64)) for k in (0, 0x5851F42D4C957F2D))


def _kind(docs: DataFrame, column: str) -> str:
    return docs.schema[column].dataType.simpleString()


def signatures(docs: DataFrame, *, id_column: str, text: str, width: int) -> DataFrame:
    """Of each row: id, a hash of the text, n_shingles, 128 bits that identify the set, its bands' keys and its packed low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(text_column(batch, "text")):
                sizes, marks, low = [], [], []
                for s in shingle_sets(data, offsets, width):
                    sizes.append(len(s))
                    marks.append(_set_hash(s))
                    low.append(minima(s))
                low = np.array(low, np.uint32).reshape(-1, _PERMUTATIONS)
                bands = (low.reshape(-1, BANDS, ROWS).astype(np.uint64) * _FOLD).sum(axis=2, dtype=np.uint64)
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)).astype(np.int64)
                nibbles = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(low), -1, 64 // BITS)
                packed = (nibbles << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).astype(np.int64)
                yield pa.record_batch(
                    [
                        *(c.slice(first, end - first) for c in batch.columns[:2]),
                        pa.array(sizes, pa.int64()),
                        pa.array([m[0] for m in marks], pa.int64()),
                        pa.array([m[1] for m in marks], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(low) + 1) * BANDS, pa.int32()), pa.array(bands.ravel())),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(low) + 1) * packed.shape[1], pa.int32()), pa.array(packed.ravel())),
                    ],
                    names=["doc_id", "mark", "n_shingles", "s1", "s2", "bands", "low"],
                )

    kinds = f"doc_id {_kind(docs, id_column)}, mark bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>, low array<bigint>"
    return _marked(docs, id_column, text).mapInArrow(run, kinds)


def _marked(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))


def full_sets(docs: DataFrame, *, width: int) -> DataFrame:
    """(node, shingles array<bigint>) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(text_column(batch, "text")):
                sets = list(shingle_sets(data, offsets, width))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32()), pa.array(np.concatenate(sets).astype(np.int64)))
                yield pa.record_batch([batch.column(0).slice(first, end - first), lists], names=["node", "shingles"])

    return docs.mapInArrow(run, "node bigint, shingles array<bigint>")


def _agreeing(x: str, y: str) -> str:
    """SQL: the number of equal values in two packed signatures, by bit counts."""
    ones = sum(1 << k for k in range(0, 64, BITS)) - (1 << 64 if BITS == 1 else 0)
    fold = " | ".join(f"shiftrightunsigned(v, {k})" for k in range(BITS))
    return f"aggregate(zip_with({x}, {y}, (p, q) -> p ^ q), {_PERMUTATIONS}, (n, v) -> n - bit_count(({fold}) & {ones}L))"


def _estimate() -> str:
    """SQL: a pair's similarity by its signatures (low_a, low_b), corrected for chance agreement."""
    chance = 2.0**-BITS
    return f"({_agreeing('low_a', 'low_b')} / {_PERMUTATIONS}D - {chance}) / (1 - {chance})"


def _possible(percent: int, slack: float) -> str:
    """SQL over a pair's sizes and signatures (suffixes _a and _b): whether their similarity may reach the threshold."""
    return f"100 * least(n_shingles_a, n_shingles_b) >= {percent} * greatest(n_shingles_a, n_shingles_b) and {_estimate()} >= {percent / 100 - slack}D"


def _side(of: DataFrame, k: str) -> DataFrame:
    return of.select(*(F.col(c).alias(k if c == "node" else f"{c}_{k}") for c in of.columns))


def _signed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes and signatures of both."""
    low = nodes.select("node", "low", "n_shingles")
    return pairs.join(_side(low, "a"), "a").join(_side(low, "b"), "b")


def _linked(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    both = likely.join(_side(sets, "b"), "b").join(_side(sets, "a"), "a").select("a", "b", common.alias("c"), (F.size("shingles_a") + F.size("shingles_b")).alias("t"))
    return both.where(f"100 * c >= {percent} * (t - c)").select("a", "b")


def _close_links(scratch: Scratch, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between members (pivot, node, component) of one pivot that are in different components; (a, b).

    With ``whole = 100 + percent``, x and y are linked if ``whole * |common shingles| >= percent * (|x| + |y|)``. Let ``w`` be
    percent * |x| + whole * |missing of x|; then ``whole * |common differences| >= w_x + w_y - whole * |c|`` says the same, and the
    pivot is the member without differences, w = percent * |c|.
    """
    whole = 100 + percent
    known = members.join(_side(sets, "p").withColumnRenamed("p", "pivot"), "pivot").join(sets, "node")
    known = known.select(
        "pivot",
        "node",
        "component",
        F.size("shingles_p").cast("long").alias("c"),
        F.size("shingles").cast("long").alias("size"),
        F.array_except("shingles_p", "shingles").alias("missing"),
        F.array_except("shingles", "shingles_p").alias("added"),
    )
    known = known.select("pivot", "node", "component", "c", F.expr(f"{percent}L * size + {whole}L * size(missing)").alias("w"), F.concat("missing", "added").alias("differences"))
    known = scratch.save(known, "differences")
    near = f"w <= ({whole - percent}L) * c"
    direct = known.where(near).where("pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    # A member near the pivot is in its component, so only those that are not can be linked with it unknown.
    least = f"if({near}, {whole - percent}L * c + 1, {percent}L * c)"
    each = known.select("pivot", "node", F.explode("differences").alias("d"))
    rarity = each.groupBy("pivot", "d").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Differences of one member alone come first of all and meet with none; their number is what counts.
    ranked = each.join(rarity, ["pivot", "d"]).groupBy("pivot", "node").agg(F.sort_array(F.collect_list(F.struct("n", "d"))).alias("shared"))
    slim = known.select("pivot", "node", "component", "c", "w", F.size("differences").cast("long").alias("k"), F.expr(least).alias("least"))
    first = slim.join(ranked, ["pivot", "node"]).select(*slim.columns, F.posexplode("shared").alias("at", "s"), F.size("shared").alias("held"))
    # ``left``: how many differences come after this one.
    first = first.select("pivot", "node", "component", "c", "w", F.expr("held - at - 1").cast("long").alias("left"), F.col("s.d").alias("d"), "least")
    first = scratch.save(first.where(f"w + least - {whole}L * c <= {whole}L * (left + 1)").drop("least"), "firsts")
    a, b = (first.select("pivot", "d", "c", *(F.col(x).alias(f"{x}_{k}") for x in ("node", "component", "w", "left"))) for k in "ab")
    meet = f"node_a < node_b and component_a <> component_b and w_a + w_b - {whole}L * c <= {whole}L * (least(left_a, left_b) + 1)"
    met = a.join(b.drop("c"), ["pivot", "d"]).where(meet).select("pivot", F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    sides = {k: known.select("pivot", F.col("node").alias(k), F.col("w").alias(f"w_{k}"), F.col("differences").alias(f"of_{k}"), *(["c"] if k == "a" else [])) for k in "ab"}
    sure = F.expr(f"{whole}L * size(array_intersect(of_a, of_b)) >= w_a + w_b - {whole}L * c")
    return direct.unionAll(met.join(sides["a"], ["pivot", "a"]).join(sides["b"], ["pivot", "b"]).where(sure).select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85, slack: float = SLACK, turns: int = 1) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (its component's smallest id) and kept."""
    scratch = Scratch(docs.sparkSession, "near")
    marks = scratch.save(signatures(docs, id_column=id_column, text=text, width=width), "marks")
    named = marks.where("doc_id is not null and n_shingles > 0")
    # One node for each distinct set, numbered as it is written; its least id stands for it.
    stands = F.min(F.struct("doc_id", "mark")).alias("stands")
    distinct = named.groupBy("s1", "s2").agg(stands, F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    nodes = scratch.save(distinct.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "stands.*", "n_shingles", "bands", "low"), "nodes")
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.save(rows.join(shared, "bucket"), "members")
    # The member that shares buckets with most others is the likeliest source of a group of copies, so it is the centre.
    fame = members.groupBy("node").agg(F.sum("n").alias("fame"))
    known = members.select("bucket", "node").join(fame, "node")
    centres = known.groupBy("bucket").agg(F.max(F.struct("fame", (-F.col("node")).alias("r"))).alias("c")).select("bucket", (-F.col("c.r")).alias("centre"))
    buckets = scratch.save(known.join(centres, "bucket"), "buckets-0")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "mark")
    texts = _marked(docs, id_column, text).join(wanted, ["doc_id", "mark"]).groupBy("node").agg(F.first("text").alias("text"))
    sets = scratch.save(full_sets(texts, width=width), "sets")

    star = _signed(buckets.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), nodes)
    links = scratch.save(_linked(star.where(_possible(percent, slack)).select("a", "b"), sets, percent), "links-0")
    # Texts of one id are one document.
    mixed = named.groupBy("doc_id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi")
    own = scratch.save(named.join(mixed, "doc_id", "left_semi").join(nodes.select("s1", "s2", "node"), ["s1", "s2"]).select("doc_id", "node").distinct(), "mixed")
    if not own.isEmpty():
        links = links.unionAll(own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).where("a <> b"))
    found = components(scratch, links, "c0")
    open_rows = buckets.where("node <> centre").select("bucket", "node", "fame", F.col("centre").alias("pivot"))
    for turn in range(1, turns + 2):
        placed = open_rows.join(found, "node", "left").select("bucket", "node", "fame", "pivot", F.coalesce("component", "node").alias("component"))
        parts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("fame", (-F.col("node")).alias("r"))).alias("top"))
        divided = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("top", "component")).alias("lead")).where("parts > 1")
        now = scratch.save(placed.join(divided.select("bucket", (-F.col("lead.top.r")).alias("centre"), F.col("lead.component").alias("of")), "bucket"), f"buckets-{turn}")
        if now.isEmpty():
            break
        if turn > turns:
            more = _close_links(scratch, now.select("pivot", "node", "component").distinct(), sets, percent)
        else:
            pairs = now.where("component <> of").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
            more = _linked(_signed(pairs, nodes).where(_possible(percent, slack)).select("a", "b"), sets, percent)
        more = scratch.save(more, f"links-{turn}")
        if not more.isEmpty():
            links = links.unionAll(more)
            found = components(scratch, links, f"c{turn}")
        open_rows = now.where("node <> centre").select("bucket", "node", "fame", "pivot")

    of = found.join(nodes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = found.join(of, "component").select("node", "component_id")
    member = nodes.select("s1", "s2", "node", "doc_id").join(linked, "node", "left").select("s1", "s2", F.coalesce("component_id", "doc_id").alias("component_id"))
    own_id = F.expr("if(n_shingles > 0 and doc_id is not null, component_id, doc_id)").alias("component_id")
    labelled = marks.select("doc_id", "n_shingles", "s1", "s2").join(member, ["s1", "s2"], "left").select("doc_id", "n_shingles", own_id).withColumn("kept", F.expr("doc_id <=> component_id"))
    out = scratch.save(labelled, "labelled")
    scratch.keep("labelled")
    return out


def deduplicate(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose id stands for its component (all rows of an id stay or go together); rows without an id stay."""
    extra = salted(docs)
    gone = near_duplicates(docs, id_column=id_column, text=text, width=width, percent=percent).where("not kept").select(F.col("doc_id").alias(extra)).distinct()
    return docs.join(gone, docs[id_column] == gone[extra], "left_anti")


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


#: The links of all pairs of distinct sets that share a shingle, and the least id that each set reaches.
OP5_SQL = r"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w),
n AS MATERIALIZED (SELECT s, min(doc_id) AS node, len(s) AS k FROM s WHERE len(s) > 0 GROUP BY s),
x AS MATERIALIZED (SELECT node, k, unnest(s) AS h FROM n),
p AS (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.h = b.h AND a.node < b.node AND 100 * least(a.k, b.k) >= 85 * greatest(a.k, b.k) GROUP BY a.node, b.node, a.k, b.k HAVING 100 * count(*) >= 85 * (a.k + b.k - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, root) AS (SELECT node, node FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE e.b >= r.root),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.root, s.doc_id) AS component_id, s.doc_id = coalesce(c.root, s.doc_id) AS kept FROM s LEFT JOIN n ON n.s = s.s LEFT JOIN c ON c.node = n.node"""
