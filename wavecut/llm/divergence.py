"""Divergence of the sources of each language, by the words they use.

Every (language, source) group has a segment tree over the language's term ids, with its counts as leaves.  The
trees are hash-consed: equal subtrees, of any group and at any place, are one node.  Two groups are compared by
walking both trees at once; a pair of nodes is priced once for a pair of groups, wherever it comes up again.

The term ids of a language are cut into blocks by hash, so that a subtree of every group's tree lies in each block
and no task holds a whole vocabulary; prices of blocks add up.  Inside a block the terms are ordered by their count
in the language, which puts the rare ones, whose counts are alike, into common subtrees.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecut.llm.common import run_path, written
from wavecut.sources.storage import join_small

SCALE = 1_000_000_000
#: Bytes of terms: A-Z in lower case, a-z and all of multi-byte characters; the rest separates.
LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
COUNTS = "lang string, source string, term string, n long, d long"
PRICES = "lang string, source string, part string, item string, value long"


def term_counts(docs: DataFrame, lang: str, source: str, text: str, held: int = 400_000) -> DataFrame:
    """``lang, source, term, n, d``: occurrences and documents of each term; an empty term stands for the group itself.

    Tasks add up before the shuffle, in a table of at most about ``held`` terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (l, s), (n, d) in tables.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([l] * len(terms), pa.string()), pa.array([s] * len(terms), pa.string()),
                     pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()),
                     pa.array([d[t] for t in terms], pa.int64())],
                    names=["lang", "source", "term", "n", "d"],
                )

        for batch in batches:
            for l, s, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n, d = tables.setdefault((l, s), (Counter({b"": 0}), Counter()))
                words, before = t.translate(LETTERS).split(), len(n)
                n.update(words)
                d.update(set(words))
                size += len(n) - before
                if size > held:
                    yield from flushed()
                    tables, size = {}, 0
        yield from flushed()

    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source, text)]
    rows = docs.select(filled[0].alias("l"), filled[1].alias("s"), filled[2].cast("binary").alias("t"))
    return rows.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def weights(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Smoothed shares as whole numbers: 1 + floor(SCALE * (count + 2) / total)."""
    if len(counts) and int(counts.max()) > (1 << 62) // SCALE:
        return np.array([1 + SCALE * (int(c) + 2) // int(t) for c, t in zip(counts, total)], dtype=np.int64)
    return 1 + SCALE * (counts + 2) // total


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Forest:
    """Hash-consed segment trees of the rows of a matrix of counts; ``-1`` fills a row up to a power of two."""

    def __init__(self, counts: np.ndarray):
        """``values``: of the distinct leaves; ``children[k]``: both children of each node of level k + 1."""
        self.values, ids = np.unique(counts, return_inverse=True)
        ids = ids.reshape(counts.shape)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while ids.shape[1] > 1:
            span = int(ids.max()) + 1
            nodes, up = np.unique(ids[:, 0::2].astype(np.int64) * span + ids[:, 1::2], return_inverse=True)
            self.children.append((nodes // span, nodes % span))
            ids = up.reshape(len(ids), -1)
        self.roots = ids[:, 0]

    def prices(self, a: int, others: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Divergence of row ``a`` from each of the other rows.

        Level by level, from the roots: the distinct node pairs of each pair of trees, then their prices from the
        leaves up; each is found once.
        """
        x, y, who = np.full(len(others), self.roots[a], dtype=np.int64), self.roots[others].astype(np.int64), np.arange(len(others))
        back = []
        for left, right in reversed(self.children):
            x, y, who = np.concatenate([left[x], right[x]]), np.concatenate([left[y], right[y]]), np.concatenate([who, who])
            span = int(max(x.max(), y.max())) + 1
            pairs, inverse = np.unique((who * span + x) * span + y, return_inverse=True)
            back.append(inverse)
            x, y, who = pairs // span % span, pairs % span, pairs // (span * span)
        u, v = self.values[x], self.values[y]
        price, real = np.zeros(len(u), dtype=np.int64), u >= 0
        u, v, who = u[real], v[real], who[real]
        price[real] = gaps(weights(u, np.full(len(u), totals[a])), weights(v, totals[others[who]]))
        for inverse in reversed(back):
            price = price[inverse[: len(inverse) // 2]] + price[inverse[len(inverse) // 2:]]
        return price


def block_prices(rows: pa.Table, top: int) -> pa.Table:
    """Prices of all pairs of groups between two chunks of a language's sources over one block of its terms.

    ``own`` and ``other`` chunks are equal in one of the tasks of each chunk: there the pairs inside the chunk are
    priced, and the block's ``top`` terms of each source against the language.
    """
    lang, first, second = (rows.column(c)[0].as_py() for c in ("lang", "c", "d"))
    sources, at = np.unique(np.array(rows.column("source").to_pylist(), dtype=object), return_inverse=True)
    own, size = np.zeros(len(sources), dtype=np.int64), np.ones(len(sources), dtype=np.int64)
    own[at], size[at] = rows.column("own").to_numpy(), rows.column("size").to_numpy()
    real = rows.column("term").is_valid().to_numpy(zero_copy_only=False)
    terms, where = rows.column("term").to_pylist(), np.flatnonzero(real)
    total, n = rows.column("total").to_numpy(), rows.column("n").to_numpy()
    known = {terms[i]: int(total[i]) for i in where.tolist()}
    ordered = sorted(known, key=lambda t: (-known[t], t))
    place = {t: i for i, t in enumerate(ordered)}
    leaves = int(total[~real].max())  # with the terms that no source of these chunks uses
    counts = np.full((len(sources), 1 << max(0, leaves - 1).bit_length()), -1, dtype=np.int64)
    counts[:, :leaves] = 0
    counts[at[where], np.array([place[terms[i]] for i in where.tolist()], dtype=np.int64)] = n[where]
    out: list[tuple[str, str, str, int]] = []
    forest = Forest(counts)
    for a in range(len(sources)):
        later = np.flatnonzero((np.arange(len(sources)) > a) & ((own != own[a]) | (first == second)))
        if len(later):
            for b, value in zip(later.tolist(), forest.prices(a, later, size).tolist()):
                out += [(sources[a], "pair", sources[b], value), (sources[b], "pair", sources[a], value)]
    if first == second and len(ordered):
        whole = np.array([known[t] for t in ordered], dtype=np.int64)
        q = weights(whole, np.full(len(whole), rows.column("lang_size")[0].as_py()))
        for a in range(len(sources)):
            used = np.flatnonzero(counts[a, :len(ordered)] > 0)
            p = weights(counts[a, used], np.full(len(used), size[a]))
            used, p = used[p > q[used]], p[p > q[used]]
            value = gaps(p, q[used])
            best = sorted(zip((-value).tolist(), (ordered[i] for i in used.tolist())))[:top]
            out += [(sources[a], "term", t, -v) for v, t in best]
    return pa.table(
        [pa.array([lang] * len(out), pa.string()), *(pa.array([r[k] for r in out], pa.string()) for k in range(3)),
         pa.array([r[3] for r in out], pa.int64())],
        names=["lang", "source", "part", "item", "value"],
    )


def source_divergence(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 10, top: int = 10,
    block: int = 1024, chunk: int = 48, folder: str | None = None,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source lies from the others, and by which terms.

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` terms that the source uses
    more than its language.  Shares are smoothed counts of the terms that occur in ``least_docs`` rows of the
    language; all arithmetic is in whole numbers.  Rank 1 is the largest value, ties go to the smaller item in UTF-8.

    NULL and empty text, language and source are the same, and a language or source of its own.  Rows without terms
    form groups like others; repeated rows count each time.  A language without kept terms gives pairs of value 0; a
    language with one source gives no pairs; an empty table gives no rows.  Texts and terms may be of any length.  Other
    columns are not read, whatever their names.  A task holds at most about ``block`` terms of two chunks of
    ``chunk`` sources.
    """
    folder = folder or run_path(docs.sparkSession, "divergence")
    counts = written(term_counts(docs, lang, source, text), f"{folder}/counts")
    terms = counts.where("term <> ''")
    vocabulary = terms.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("docs")).where(F.col("docs") >= least_docs)
    kept = written(terms.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "total"), f"{folder}/kept")
    used = kept.groupBy("lang", "source").agg(F.sum("n").alias("used"))
    langs = kept.select("lang", "term", "total").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_used"))
    there = counts.where("term = ''").select("lang", "source").distinct()
    sources = there.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    groups = there.join(sources, "lang").join(langs, "lang", "left").join(used, ["lang", "source"], "left").na.fill(0, ["terms", "lang_used", "used"])
    chunks, blocks = F.ceil(F.col("sources") / chunk), F.greatest(F.lit(1), F.ceil(F.col("terms") / block))
    groups = written(
        groups.select(
            "lang", "source", (F.col("used") + 2 * F.col("terms")).alias("size"), (F.col("lang_used") + 2 * F.col("terms")).alias("lang_size"),
            F.pmod(F.xxhash64("source"), chunks).cast("int").alias("own"), chunks.cast("int").alias("chunks"), blocks.cast("int").alias("blocks"),
        ),
        f"{folder}/groups",
    )
    leaves = join_small(kept, groups, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    columns = ["lang", "block", "own", "chunks", "source", "size", "lang_size", "term", "n", "total"]
    # A group takes part in every block of its language, with or without terms there; its row has the block's number of terms.
    lengths = leaves.select("lang", "block", "term").distinct().groupBy("lang", "block").agg(F.count(F.lit(1)).alias("total"))
    present = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(lengths, ["lang", "block"], "left").withColumns(
        {"term": F.lit(None).cast("string"), "n": F.lit(0).cast("bigint"), "total": F.coalesce("total", F.lit(0).cast("bigint"))}
    )
    dealt = leaves.select(*columns).unionByName(present.select(*columns)).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    ).select("*", F.least("own", "other").alias("c"), F.greatest("own", "other").alias("d")).drop("chunks", "other")
    prices = dealt.groupBy("lang", "block", "c", "d").applyInArrow(lambda rows: block_prices(rows, top), PRICES)
    summed = prices.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
