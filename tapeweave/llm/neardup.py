"""Near-duplicate groups: fast similarity sketching, banding, exact verification.

1. Each text becomes its set of word shingles, as 64-bit hashes, and a *fast
   similarity sketch*: in round ``i`` every shingle is thrown into one hashed
   bin with value ``i + hash``; rounds go on until every bin of the text is
   filled, and from round ``t`` on shingle hashes go to bin ``i - t`` outright,
   so ``2 t`` rounds always suffice.  Each bin keeps its least value; two
   sketches agree in a bin with probability equal to the Jaccard similarity,
   and the agreements concentrate like independent ones.
2. Equal shingle sets collapse to one class, named by a 128-bit digest.
3. Sketches are cut into bands; classes that share a band are tied to the
   smallest class of that bucket.  Connected ties make *candidate clusters*.
4. Only clustered classes fetch their full sets, once, dealt by cluster in
   blocks of bounded size, and every pair inside a block is verified exactly.
   Clusters of several blocks then deal the classes outside their largest
   verified component in blocks too, and compare these with every block of the
   component and with one another, two blocks at a time: no pair is left out,
   members that are already tied together are not compared again, and no task
   holds more than two blocks.
5. Verified links give the final components.

No pair is ever sent through a shuffle: what is exchanged are band keys, one
star edge per class and bucket, shingle sets (once, or once a pair of blocks
for large clusters with stragglers), and verified spanning links.  Buckets,
clusters and components of any size meet their one fact by ``join_by_key``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, components, cut, join_by_key, mix, quoted, slices


@dataclass(frozen=True)
class NearDupParams:
    """``percent``: a link needs ``100 * intersection >= percent * union``.
    ``bands`` of ``rows`` coordinates: a pair at the threshold shares no band
    with probability ``(1 - 0.85 ** 6) ** 32`` = 3e-7 by default, less for more
    similar pairs.  ``block``: shingles, over all members, that one
    verification block holds."""

    words: int = 5
    percent: int = 85
    bands: int = 32
    rows: int = 6
    block: int = 400_000


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words (A-Z
    lower-cased); fewer words make one shingle, none an empty set."""
    words = Words(texts, lower=True)
    codes, distinct = words.coded()
    seed = np.fromiter((int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))
    hashes = seed[codes] if len(codes) else np.zeros(0, dtype=np.uint64)
    n, rolled = len(hashes), np.zeros(len(hashes), dtype=np.uint64)
    if n >= size:
        rolled[: n - size + 1] = hashes[: n - size + 1]
        for k in range(1, size):
            rolled[: n - size + 1] = mix(rolled[: n - size + 1], k) ^ hashes[k : n - size + 1 + k]
        rolled = mix(rolled, 99)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8, key=b"short").digest()
            out.append(np.frombuffer(whole, dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches of ``t`` bins, one row per set.  Rows of empty
    sets are meaningless."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    empty = np.iinfo(np.uint64).max
    out = np.full(len(sets) * t, empty, dtype=np.uint64)
    for i in range(2 * t):
        h = mix(flat, i + 1)
        bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32) if i < t else np.full(len(flat), i - t, dtype=np.uint64)
        # the round is the high part: a bin filled in an earlier round keeps it
        np.minimum.at(out, owner * t + bins.astype(np.int64), (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
        open_rows = (out.reshape(-1, t) == empty).any(axis=1) & (sizes > 0)
        if not open_rows.any():
            break
        still = open_rows[owner]
        flat, owner = flat[still], owner[still]
    return out.reshape(-1, t)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _profiles(p: NearDupParams):
    t = p.bands * p.rows

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), p.words)
            keys = sketches(sets, t).reshape(len(sets) * p.bands, p.rows)
            band = np.tile(np.arange(p.bands, dtype=np.uint64), len(sets))
            for k in range(p.rows):
                band = mix(band ^ keys[:, k], k)
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(band) + 1, p.bands), pa.int32()), pa.array(band.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("hash"), batch.column("digest"), pa.array(sizes), pa.array([_digest(x) if len(x) else None for x in sets], pa.binary()), lists],
                names=["doc_id", "hash", "digest", "n_shingles", "class", "bands"],
            )

    return profile


def _verify_block(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning links among ``sets``, compared on their full sets: members of
    ``sides`` 0 with each other, and those of 2 with those of 1."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    _, codes = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # inverted lists: the members that hold each shingle
    order = np.argsort(codes, kind="stable")
    heads = np.searchsorted(codes[order], np.arange(codes.max() + 2))
    holders = owner[order]
    ends = np.cumsum(sizes)
    group = np.arange(len(sets))
    links = []
    for i in range(len(sets)):
        if sides[i] == 1:
            continue
        mine = codes[ends[i] - sizes[i] : ends[i]]
        shared = mine[heads[mine + 1] - heads[mine] > 1]
        if not len(shared):
            continue
        spans = heads[shared + 1] - heads[shared]
        at = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(heads[shared], spans)
        common = np.bincount(holders[at], minlength=len(sets))
        union = sizes + sizes[i] - common
        near = np.flatnonzero(100 * common >= percent * union)
        for j in near[(near > i) & (sides[near] == 0) if sides[i] == 0 else sides[near] == 1].tolist():
            if group[i] != group[j]:
                group[group == group[j]] = group[i]
                links.append((i, j))
    return links


def _verifier(p: NearDupParams):
    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("class")
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["shingles"]]
        names = rows["class"].tolist()
        found = _verify_block(sets, rows["side"].to_numpy(), p.percent)
        return pd.DataFrame({"u": pd.Series([names[a] for a, _ in found], dtype=object), "v": pd.Series([names[b] for _, b in found], dtype=object)})

    return verify


def _fetch(size: int):
    """Shingle sets of the wanted texts.  Rows come in the order of the join's
    key, so repeated ones follow each other and only the first is worked on."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in slices(batches, "text"):
            names = batch.column("class").to_pylist()
            batch = batch.filter(pa.array([a != b for a, b in zip(names, [before, *names])], pa.bool_()))
            before = names[-1]
            sets = shingle_sets(batch.column("text"), size)
            right = np.array([_digest(x) == c for x, c in zip(sets, batch.column("class").to_pylist())], dtype=bool)
            made = pa.RecordBatch.from_arrays(
                [batch.column("cluster"), batch.column("block"), batch.column("class"), pa.array([x.tobytes() for x in sets], pa.binary())], names=["cluster", "block", "class", "shingles"]
            )
            yield made.filter(pa.array(right))

    return fetch


def _meetings(wide: DataFrame, part: DataFrame, block: int, total: int) -> DataFrame:
    """Which blocks of the clusters in ``wide`` (``cluster, class, n_shingles,
    blocks, block``; of several blocks, out of ``total`` rows at most) meet, as
    ``class, cluster, i, j, side``.  ``part`` has the components verified so
    far: the stragglers' blocks meet the main component's, and one another.

    The main component's blocks have the numbers below ``blocks``, the
    stragglers' those from there on.
    """
    sited = cut(wide.join(part, wide["class"] == part["node"], "left").withColumn("root", F.coalesce("root", "class")).drop("node"))
    roots = sited.groupBy("cluster", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    facts = roots.groupBy("cluster").agg(F.max_by(F.struct("root", "size"), F.struct("n", "root")).alias("main"), F.sum("size").alias("all"), F.sum("n").alias("members"))
    strays = F.ceil((F.col("all") - F.col("main.size")) / F.lit(block)).cast("int")
    facts = cut(facts.select("cluster", F.col("main.root").alias("main"), strays.alias("strays"), "members").where("strays > 0"))
    sited = join_by_key(sited, facts, "cluster", "members", total).withColumn("own", F.pmod(F.xxhash64("class"), F.col("strays")).cast("int"))
    at = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own, first = F.col("own"), F.col("blocks")
    with_main = F.transform(every("blocks"), lambda k: at(k, own, 2))
    with_strays = F.transform(every("strays"), lambda k: F.when(k == own, at(first + own, own, 0)).when(k < own, at(first + k, own, 1)).otherwise(at(first + own, k, 2)))
    with_stray = F.transform(every("strays"), lambda k: at(F.col("block"), k, 1))
    meets = F.when(F.col("root") == F.col("main"), with_stray).otherwise(F.concat(with_main, with_strays))
    return sited.select("class", "cluster", F.explode(meets).alias("at")).select("class", "cluster", "at.*")


def near_dedup(docs: DataFrame, params: NearDupParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose shingle sets are near-duplicates.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept``,
    where ``component_id`` is the smallest identifier reachable over verified
    links and equal sets, and ``kept`` marks the row that carries it.

    Null, empty or blank text: an empty set, linked with nothing, its own
    component.  Null identifier: linked like any other row, but never names a
    component unless all of the component's are null, and then all its rows are
    kept.
    Repeated rows get the same answer each.  Other columns are ignored.
    """
    return _answers(docs, params or NearDupParams(), id_col, text_col, "cast(null AS binary)").drop("digest")


def _answers(docs: DataFrame, p: NearDupParams, id_col: str, text_col: str, digest: str) -> DataFrame:
    """``near_dedup`` with one more column, the expression ``digest`` of each row."""
    base = docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"cast(`{text_col}` as string) AS text").withColumn("hash", F.xxhash64("text"))
    seen = cut(base.selectExpr("*", f"{digest} AS digest").mapInArrow(_profiles(p), "doc_id long, hash long, digest binary, n_shingles long, class binary, bands array<long>"))
    # a class's text is fetched by identifier and hash of one of its rows
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")
    classes = cut(seen.where("class IS NOT NULL").groupBy("class").agg(F.min(row).alias("row"), F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    n_classes = classes.count()
    members = classes.select("class", F.posexplode("bands").alias("band", "key"))
    buckets = cut(members.groupBy("band", "key").agg(F.min("class").alias("pivot"), F.count("*").alias("n")).where("n > 1"))
    ties = join_by_key(members, buckets, ["band", "key"], "n", n_classes * p.bands).where("class <> pivot").select(F.col("class").alias("u"), F.col("pivot").alias("v"))
    clusters = components(ties)
    placed = cut(clusters.join(classes.select("class", "row", "n_shingles"), clusters["node"] == classes["class"]).select("class", "row", "n_shingles", F.col("root").alias("cluster")))
    blocks = placed.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / F.lit(p.block)).cast("int").alias("blocks"), F.count("*").alias("members"))
    sited = cut(join_by_key(placed, cut(blocks), "cluster", "members", n_classes).drop("members").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")))
    wanted = sited.select("class", F.col("row.doc_id").alias("w_id"), F.col("row.hash").alias("w_hash"), "cluster", "block")
    # the clustered classes grow with the input: one plan at every size
    found = base.join(wanted.hint("merge"), base["doc_id"].eqNullSafe(wanted["w_id"]) & (base["hash"] == wanted["w_hash"]))
    sets = cut(found.select("text", "class", "cluster", "block").mapInArrow(_fetch(p.words), "cluster binary, block int, class binary, shingles binary"))
    pairs = "u binary, v binary"
    local = cut(sets.withColumn("side", F.lit(0)).groupBy("cluster", "block").applyInPandas(_verifier(p), pairs))
    links = local
    wide = sited.where("blocks > 1")
    if not wide.isEmpty():
        meet = _meetings(wide, components(local), p.block, n_classes)
        links = local.unionByName(cut(meet.join(sets.select("class", "shingles"), "class").groupBy("cluster", "i", "j").applyInPandas(_verifier(p), pairs)))
    final = components(links)
    named = cut(classes.join(final, classes["class"] == final["node"], "left").select("class", F.col("row.doc_id").alias("head"), F.coalesce("root", "class").alias("root")))
    names = cut(named.groupBy("root").agg(F.min("head").alias("component_id"), F.count("*").alias("n")))
    answer = cut(join_by_key(named, names, "root", "n", n_classes).select("class", "component_id"))
    return _answer(seen, answer)


def _answer(seen: DataFrame, answer: DataFrame) -> DataFrame:
    """Each row's component; classes with many copies do not meet in one task."""
    sizes = seen.groupBy("class").count()
    total = seen.count()
    hot = sizes.where(F.col("count") > max(1, total // 1000)).select("class")
    facts = F.broadcast(answer.join(F.broadcast(hot), "class"))  # fewer than 1000 rows
    rows = seen.select("doc_id", "digest", "n_shingles", "class")
    joined = (
        rows.join(facts, "class")
        .unionByName(rows.where("class IS NOT NULL").join(F.broadcast(hot), "class", "left_anti").join(answer, "class"))
        .unionByName(rows.where("class IS NULL").withColumn("component_id", F.col("doc_id")))
    )
    return joined.select("doc_id", "digest", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, params: NearDupParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group; same columns.

    Rows are removed by identifier and text, so that other texts of the same
    identifier stay, and every repeat of a row shares its fate.  Null, empty or
    blank texts are linked with nothing and stay.  A row with a null identifier
    goes if its group has a named row; groups without one stay whole.
    """
    digest = lambda text: f"unhex(sha2(coalesce({text}, ''), 256))"
    answers = _answers(docs, params or NearDupParams(), id_col, text_col, digest("text"))
    gone = answers.where("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__gone_text")).distinct()
    marked = docs.withColumns({"__id": F.col(quoted(id_col)).cast("long"), "__text": F.expr(digest(f"cast(`{text_col}` AS string)"))})
    return marked.join(gone, marked["__id"].eqNullSafe(gone["__gone"]) & (marked["__text"] == gone["__gone_text"]), "left_anti").select(*map(quoted, docs.columns))
