"""Links between claims and posts or articles by cosine similarity in a time window."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.claims import LINK_THRESHOLD, window_start
from claimweave.session import cut_lineage

#: Pairs of posts and claims that one task forms.
PAIRS_A_TASK = 2_000_000
#: So many links of articles are sent to all tasks at most; of more, a task holds as many as are in its block of claims.
SENT_LINKS, HELD_LINKS = 500_000, 2_000_000
#: Pairs through articles that a task passes on where the links of articles are not sent to all.
PAIRS_A_CELL = 50_000_000
#: Numbers in the vectors of a block of claims whose links are reduced in the task.
BLOCK_VALUES = 1 << 23
#: Stands for no value among the ids that are reduced to the least.
NOTHING = (1 << 63) - 1


class Via(NamedTuple):
    """Links through articles in two tables, ``post_article(post_id, article_id)``, distinct, and
    ``article_links(article_id, claim_id, score)``. A post has the claims of all its articles; operators that
    only want a minimum, a maximum or an existence per post or claim take it article by article and
    never form the pairs, which are far more than both tables together."""

    post_article: DataFrame
    article_links: DataFrame


def _score_blocks(threshold: float, strip: int = 256, weights: Sequence[float] | None = None):
    """Score blocks of claims against blocks of items, with ``weights`` for vectors that are counts. Rows come block by block, the claims of a block first; its claims are
    held, its items go by a strip at a time, and the pairs above the threshold go out strip by strip.
    Self-contained, so that workers need numpy and pyarrow but not this package."""

    def unit(column: pa.Array) -> np.ndarray:
        m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
        if weights is not None:
            m *= np.asarray(weights)
        with np.errstate(invalid="ignore", divide="ignore"):
            return m / np.sqrt((m * m).sum(axis=1, keepdims=True))

    def numbers(rows: pa.RecordBatch, *names: str) -> list[np.ndarray]:
        return [rows.column(n).to_numpy(zero_copy_only=False) for n in names]

    def score(claims: list, items: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        claim_ids, lo, hi, c = claims
        for start in range(0, items.num_rows, strip):
            some = items.slice(start, strip)
            item_ids, at = numbers(some, "id", "lo")
            scores = unit(some.column("vec")) @ c.T
            when = at[:, None]
            i, j = np.nonzero((scores > threshold) & (when >= lo) & (when <= hi))
            if len(i):
                yield pa.RecordBatch.from_pydict({"item_id": item_ids[i], "claim_id": claim_ids[j], "score": scores[i, j]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, claims = None, []
        for batch in batches:
            keys = np.stack(numbers(batch, "day", "cb", "pb", "kind"), axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                *here, kind = keys[a].tolist()
                if here != block:
                    block, claims = here, []
                rows = batch.slice(a, b - a)
                if kind == 0:
                    claims.append([*numbers(rows, "id", "lo", "hi"), unit(rows.column("vec"))])
                elif claims:
                    if len(claims) > 1:
                        claims = [[np.concatenate(x) for x in zip(*claims)]]
                    yield from score(claims[0], rows)

    return run


def _deal(claims: DataFrame, items: DataFrame, window_days: int, block_rows: int, *more: str) -> DataFrame:
    """Both sides in blocks of a calendar day, see :func:`link_by_cosine`, with the columns ``more`` of both."""
    c = claims.filter(F.col("embedding").isNotNull() & F.col("date").isNotNull()).select(
        F.col("claim_id").cast("bigint"),
        F.unix_micros(window_start(F.col("date"), window_days)).alias("lo"),
        F.unix_micros("date").alias("hi"),
        F.explode(
            F.sequence(F.to_date(window_start(F.col("date"), window_days)), F.to_date("date"))
        ).alias("day"),
        F.col("embedding").alias("vec"),
        *more,
    )
    p = items.filter(F.col("embedding").isNotNull() & F.col("created_at").isNotNull()).select(
        F.col("item_id").cast("bigint"),
        F.unix_micros("created_at").alias("at"),
        F.to_date("created_at").alias("day"),
        F.col("embedding").alias("vec"),
        *more,
    )

    def blocks(df: DataFrame, name: str, rows: int) -> DataFrame:
        n = F.count(F.lit(1))
        return df.groupBy("day").agg(F.ceil(n / rows).cast("int").alias(name))

    # One row per calendar day, so this table has a few thousand rows at any data size.
    days = F.broadcast(blocks(c, "c_blocks", block_rows).join(blocks(p, "p_blocks", 4 * block_rows), "day"))

    def part(id_col: str, n: str):
        return F.pmod(F.xxhash64(id_col), F.col(n)).cast("int")

    keys = [F.unix_date("day").alias("day"), "cb", "pb"]
    c = (
        c.join(days, "day")
        .withColumn("cb", part("claim_id", "c_blocks"))
        .withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("p_blocks") - 1)))
        .select(*keys, F.lit(0).alias("kind"), F.col("claim_id").alias("id"), "lo", "hi", "vec", *more)
    )
    p = (
        p.join(days, "day")
        .withColumn("pb", part("item_id", "p_blocks"))
        .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)))
        .select(*keys, F.lit(1).alias("kind"), F.col("item_id").alias("id"), F.col("at").alias("lo"), F.col("at").alias("hi"), "vec", *more)
    )
    return c.unionByName(p).repartition("day", "cb", "pb").sortWithinPartitions("day", "cb", "pb", "kind")


def link_by_cosine(
    claims: DataFrame,
    items: DataFrame,
    threshold: float = LINK_THRESHOLD,
    window_days: int = 3,
    existing: DataFrame | None = None,
    block_rows: int = 16384,
    existing_via: Via | None = None,
    weights: Sequence[float] | None = None,
) -> DataFrame:
    """``(item_id, claim_id, score)`` of all pairs whose cosine is above ``threshold`` and
    whose item time lies in ``[date - window_days, date]``.

    ``claims(claim_id, date, embedding)``, ``items(item_id, created_at, embedding)``; rows
    without an embedding or a time are skipped, ``existing(item_id, claim_id)`` pairs are
    left out, and so are pairs of posts and claims that share an article of ``existing_via``.

    The window becomes an equi-join on calendar days. Each day is cut into claim blocks
    of about ``block_rows`` rows and item blocks of four times as many, so a hot day becomes many tasks of
    bounded size, and a task multiplies dense strips. Pairs below the threshold are
    never turned into rows. All pairs in the window are examined.

    A row is copied once per block of the other side. A task holds one block of claims; items and links pass
    through it in strips, so its memory does not follow the number of links.

    With ``weights``, one a dimension, the embeddings are counts that are weighed in the task: whole numbers, mostly
    small or zero, are a fraction of the size of the vectors they stand for, in every copy of a row.
    """
    dealt = _deal(claims, items, window_days, block_rows)
    links = dealt.mapInArrow(_score_blocks(threshold, weights=weights), "item_id long, claim_id long, score double")
    if existing is not None:
        links = links.join(existing.select("item_id", "claim_id"), ["item_id", "claim_id"], "left_anti")
    if existing_via is not None:
        links = _without_shared(links, existing_via)
    return links


def _fold_blocks(kind: str, over: str, thresholds: list[float], strip: int = 256, chunk: int = 8192):
    """Score blocks as :func:`_score_blocks` does, and reduce the links of each block in place, so that rows follow the
    rows of a block and not its links. ``over`` says whose links are reduced, ``item`` or ``claim``; ``kind`` what becomes of them:

    - ``best``: ``id, score``, the best score above the first threshold;
    - ``least``: ``id, at, v``, for each threshold the least number that the linked rows of the other side carry in that place of ``x``;
    - ``sums``: ``id, at, v``, for each item, of the linked claims, the second numbers of ``x`` added up by the first."""
    nothing = (1 << 63) - 1

    def unit(column: pa.Array) -> np.ndarray:
        m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return m / np.sqrt((m * m).sum(axis=1, keepdims=True))

    def block_of(rows: pa.RecordBatch) -> list[np.ndarray]:
        id_, lo, hi = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("id", "lo", "hi"))
        x = rows.column("x").flatten().to_numpy(zero_copy_only=False)
        return [id_, lo, hi, x.reshape(len(id_), len(x) // len(id_)), unit(rows.column("vec"))]

    def table(ids, at, v) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"id": ids, "at": np.broadcast_to(at, len(ids)).astype(np.int64), "v": v.astype(np.int64)})

    def start(n: int) -> np.ndarray:
        return np.full(n, -np.inf) if kind == "best" else np.full((len(thresholds), n), nothing)

    def out(ids: np.ndarray, held: np.ndarray) -> Iterator[pa.RecordBatch]:
        if kind == "best":
            some = held > -np.inf
            yield pa.RecordBatch.from_pydict({"id": ids[some], "score": held[some]})
            return
        for k, v in enumerate(held):
            yield table(ids[v < nothing], k, v[v < nothing])

    def fold(claims: list, items: list, held: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(items[0]), strip):
            ids, at, _, x, vec = (m[a : a + strip] for m in items)
            when, mine = at[:, None], start(len(ids))
            for b in range(0, len(claims[0]), chunk):
                _, lo, hi, y, c = (m[b : b + chunk] for m in claims)
                scores = vec @ c.T
                inside = (when >= lo) & (when <= hi)
                if kind == "best":
                    kept = np.where(inside & (scores > thresholds[0]), scores, -np.inf)
                    if over == "item":
                        np.maximum(mine, kept.max(axis=1), out=mine)
                    else:
                        np.maximum(held[b : b + chunk], kept.max(axis=0), out=held[b : b + chunk])
                elif kind == "least":
                    for k, t in enumerate(thresholds):
                        linked = inside & (scores > t)
                        if over == "item":
                            np.minimum(mine[k], np.where(linked, y[:, k], nothing).min(axis=1), out=mine[k])
                        else:
                            best = held[k, b : b + chunk]
                            np.minimum(best, np.where(linked, x[:, k, None], nothing).min(axis=0), out=best)
                else:
                    i, j = np.nonzero(inside & (scores > thresholds[0]))
                    groups, of = np.unique(y[:, 0], return_inverse=True)
                    cells, cell = np.unique(i * len(groups) + of[j], return_inverse=True)
                    sums = np.zeros(len(cells), np.int64)
                    np.add.at(sums, cell, y[j, 1])
                    yield table(ids[cells // len(groups)], groups[cells % len(groups)], sums)
            if over == "item" and kind != "sums":
                yield from out(ids, mine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, claims, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("day", "cb", "pb", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                *here, side = keys[a].tolist()
                if here != block:
                    if held is not None and over == "claim":
                        yield from out(claims[0][0], held)
                    block, claims, held = here, [], None
                rows = block_of(batch.slice(a, b - a))
                if side == 0:
                    claims.append(rows)
                elif claims:
                    if len(claims) > 1:
                        claims = [[np.concatenate(m) for m in zip(*claims)]]
                    held = start(len(claims[0][0])) if held is None else held
                    yield from fold(claims[0], rows, held)
        if held is not None and over == "claim":
            yield from out(claims[0][0], held)

    return run


class Scored:
    """Links that are scored anew whenever they are asked for and never written. Their number grows with the square of the
    vectors; what is asked of them here, a best score, a least value or a sum per post or claim, does not,
    and is reduced in the tasks that score, block by block.

    ``claims(claim_id, date, embedding)``, ``items(item_id, created_at, embedding)`` as for :func:`link_by_cosine`;
    ``key`` is the name of the items' id in what comes out."""

    def __init__(self, claims: DataFrame, items: DataFrame, threshold: float = LINK_THRESHOLD, key: str = "post_id", window_days: int = 3):
        self.claims, self.items, self.threshold, self.key, self.window_days = claims, items, threshold, key, window_days

    def above(self, threshold: float) -> Scored:
        return Scored(self.claims, self.items, max(threshold, self.threshold), self.key, self.window_days)

    def among(self, claims: DataFrame | None = None, items: DataFrame | None = None, how: str = "left_semi") -> Scored:
        """Only links of the given claims and items, or with ``how="left_anti"`` all but theirs."""
        c = self.claims if claims is None else self.claims.join(claims.select("claim_id"), "claim_id", how)
        p = self.items if items is None else self.items.join(items.select(F.col(self.key).alias("item_id")), "item_id", how)
        return Scored(c, p, self.threshold, self.key, self.window_days)

    def rows(self) -> DataFrame:
        """``(key, claim_id, score)``, every link; rows of repeated ids repeat."""
        found = link_by_cosine(self.claims, self.items, self.threshold, self.window_days)
        return found.withColumnRenamed("item_id", self.key)

    def pairs(self) -> DataFrame:
        """:meth:`rows` with the best score per pair. Only ids that come more than once are grouped for it, since any other
        pair is one row as it comes, and all pairs are far too many to be moved."""
        def repeated(df: DataFrame, of: str) -> DataFrame:
            return cut_lineage(df.groupBy(of).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(of))

        claims, items = repeated(self.claims, "claim_id"), repeated(self.items, "item_id").withColumnRenamed("item_id", self.key)
        out, odd = self, []
        if not claims.isEmpty():
            odd.append(out.among(claims=claims))
            out = out.among(claims=claims, how="left_anti")
        if not items.isEmpty():
            odd.append(out.among(items=items))
            out = out.among(items=items, how="left_anti")
        found = out.rows()
        return found.unionByName(best_links(*[x.rows() for x in odd], key=self.key)) if odd else found

    def _folded(self, kind: str, over: str, thresholds: list[float], schema: str, claims: DataFrame, items: DataFrame) -> DataFrame:
        one = claims.filter("embedding IS NOT NULL").select(F.size("embedding")).first()
        block_rows = max(1024, BLOCK_VALUES // max(1, one[0] if one else 1))
        return _deal(claims, items, self.window_days, block_rows, "x").mapInArrow(_fold_blocks(kind, over, thresholds), schema)

    def _over(self, end: str) -> str:
        return "claim" if end == "claim_id" else "item"

    def best(self, end: str) -> DataFrame:
        """``(end, score)``: the best score per claim, or per item if ``end`` is the name of its id."""
        nothing = F.array().cast("array<bigint>").alias("x")
        found = self._folded("best", self._over(end), [self.threshold], "id long, score double", self.claims.select("*", nothing), self.items.select("*", nothing))
        return found.groupBy(F.col("id").alias(end)).agg(F.max("score").alias("score"))

    def least(self, end: str, values: DataFrame, value: str, sizes: dict[str, float]) -> DataFrame:
        """``(size, end, value)``: the least ``value`` that linked rows of the other end have in ``values(size, other end,
        value)``, over links above the threshold of the size. Values are ids."""
        names, other = list(sizes), "item_id" if end == "claim_id" else "claim_id"
        of = self.key if other == "item_id" else other
        x = F.array(*[F.coalesce(F.min(F.when(F.col("size") == n, F.col(value))), F.lit(NOTHING)) for n in names])
        held = values.groupBy(F.col(of).alias(other)).agg(x.alias("x"))
        nothing = F.array().cast("array<bigint>").alias("x")
        if other == "claim_id":
            claims, items = self.claims.join(held, other), self.items.select("*", nothing)
        else:
            claims, items = self.claims.select("*", nothing), self.items.join(held, other)
        thresholds = [max(self.threshold, float(sizes[n])) for n in names]
        found = self._folded("least", self._over(end), thresholds, "id long, at long, v long", claims, items)
        size = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("at") + 1).cast("int"))
        return found.groupBy(size.alias("size"), F.col("id").alias(end)).agg(F.min("v").alias(value))

    def sums(self, weights: DataFrame, group: str, value: str) -> DataFrame:
        """``(key, group, value)``: for each item the sum of ``value`` over its links, of ``weights(claim_id, group,
        value)``, whole numbers."""
        x = F.array(F.col(group).cast("bigint"), F.col(value).cast("bigint")).alias("x")
        claims = self.claims.join(weights.select("claim_id", x), "claim_id")
        nothing = F.array().cast("array<bigint>").alias("x")
        found = self._folded("sums", "item", [self.threshold], "id long, at long, v long", claims, self.items.select("*", nothing))
        return found.groupBy(F.col("id").alias(self.key), F.col("at").alias(group)).agg(F.sum("v").alias(value))


def _without_shared(links: DataFrame, via: Via) -> DataFrame:
    """``links(item_id, claim_id, score)`` without those whose two ends share an article: the articles of
    both ends are compared, so the pairs through articles are not formed."""
    of_claim = via.article_links.groupBy("claim_id").agg(F.collect_set("article_id").alias("_discussed"))
    of_item = via.post_article.groupBy(F.col("post_id").alias("item_id")).agg(F.collect_set("article_id").alias("_read"))
    sides = links.join(of_claim, "claim_id", "left").join(of_item, "item_id", "left")
    shared = F.coalesce(F.arrays_overlap("_discussed", "_read"), F.lit(False))
    return sides.filter(~shared).select("item_id", "claim_id", "score")


def unlinked_claims(claims: DataFrame, links: DataFrame, threshold: float = LINK_THRESHOLD) -> DataFrame:
    """Claims without a link of at least ``threshold`` (here the bound itself counts)."""
    strong = links.filter(F.col("score") >= threshold).select("claim_id")
    return claims.join(strong, "claim_id", "left_anti")


def post_articles(links_to: DataFrame, is_article: DataFrame) -> DataFrame:
    """Distinct ``(post_id, article_id)`` of ``links_to(post_id, url)`` and ``is_article(url, article_id)``."""
    return links_to.join(is_article, "url").select("post_id", "article_id").distinct()


def read_articles(post_article: DataFrame, article_links: DataFrame) -> Via:
    """Only the links of articles that some post links to; both tables are used several times, so give written ones."""
    return Via(post_article, article_links.join(post_article.select("article_id"), "article_id", "left_semi"))


def expand_via(via: Via) -> DataFrame:
    """``(post_id, claim_id, score)``, one row per post, article and claim, dealt by post.

    The posts are spread first, over as many tasks as the counted pairs ask for. Where Spark finds the
    links of the articles small enough to send them to the posts, the pairs of a post come
    into being in one task, and grouping by post and claim moves none of them.
    """
    per_article = via.article_links.groupBy("article_id").agg(F.count(F.lit(1)).alias("_claims"))
    pairs = via.post_article.join(per_article, "article_id").agg(F.sum("_claims")).first()[0] or 0
    tasks = max(via.post_article.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS_A_TASK))
    dealt = via.post_article.repartition(tasks, "post_id")
    return dealt.join(via.article_links, "article_id").select("post_id", "claim_id", "score")


def links_via_articles(links_to: DataFrame, is_article: DataFrame, article_links: DataFrame) -> DataFrame:
    """``(post_id, claim_id, score)``: a post links to a URL of an article that discusses a
    claim; the best score per pair.

    ``links_to(post_id, url)``, ``is_article(url, article_id)``,
    ``article_links(article_id, claim_id, score)``. Posts are first reduced to distinct
    (post, article) pairs.
    """
    return best_via(read_articles(cut_lineage(post_articles(links_to, is_article)), article_links))


def best_via(via: Via) -> DataFrame:
    """``(post_id, claim_id, score)``: the best score per pair. Pairs come into being where they are compared and are not
    moved: beside few links, which go to all posts, or in blocks of posts and claims."""
    via = Via(via.post_article, cut_lineage(via.article_links))
    n_links = via.article_links.count()
    if n_links <= SENT_LINKS:
        sent = Via(via.post_article, F.broadcast(via.article_links))
        return expand_via(sent).groupBy("post_id", "claim_id").agg(F.max("score").alias("score"))
    per_article = via.article_links.groupBy("article_id").agg(F.count(F.lit(1)).alias("_claims"))
    pairs = via.post_article.join(per_article, "article_id").agg(F.sum("_claims")).first()[0] or 0
    claim_blocks = -(-n_links // HELD_LINKS)
    cores = via.post_article.sparkSession.sparkContext.defaultParallelism
    post_blocks = -(-max(cores, -(-pairs // PAIRS_A_CELL)) // claim_blocks)

    def block(of: str, n: int):
        return F.pmod(F.xxhash64(of), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # A post without an id is a post, so ids travel beside a mark for none.
    none, at = F.col("post_id").isNull(), F.coalesce("post_id", F.lit(0)).cast("bigint")
    links = via.article_links.dropna(subset=["article_id", "claim_id"]).select(
        every(post_blocks).alias("pb"), block("claim_id", claim_blocks).alias("cb"), F.lit(0).alias("kind"), F.lit(0).alias("none"),
        F.col("claim_id").cast("bigint").alias("id"), F.col("article_id").cast("bigint").alias("article"), "score",
    )
    posts = via.post_article.filter("article_id IS NOT NULL").distinct().select(
        block("post_id", post_blocks).alias("pb"), every(claim_blocks).alias("cb"), F.lit(1).alias("kind"), none.cast("int").alias("none"),
        at.alias("id"), F.col("article_id").cast("bigint").alias("article"), F.lit(0.0).alias("score"),
    )
    dealt = links.unionByName(posts).repartition(post_blocks * claim_blocks, "pb", "cb").sortWithinPartitions("pb", "cb", "kind", "none", "id")
    return dealt.mapInArrow(_best_in_cells(), "post_id long, claim_id long, score double")


def _best_in_cells(most_rows: int = 100_000):
    """Cells of links of articles, then of posts in order with their articles, to the best score per post and claim. The
    links of a cell are held, pairs go out post by post."""

    def best(links: list[np.ndarray], articles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, first, last, claims, scores = links
        at = np.searchsorted(names, articles)
        here = [x for x, a in zip(at, articles) if x < len(names) and names[x] == a]
        if not here:
            return claims[:0], scores[:0]
        c, s = (np.concatenate([m[first[x] : last[x]] for x in here]) for m in (claims, scores))
        order = np.lexsort((s, c))
        c, s = c[order], s[order]
        top = np.r_[c[1:] != c[:-1], True]
        return c[top], s[top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, links, post, reads, out, n = None, [], None, [], [], 0

        def table() -> pa.RecordBatch:
            sizes = [len(c) for _, c, _ in out]
            ids, none = (np.repeat(np.array([p[i] for p, _, _ in out]), sizes) for i in (1, 0))
            columns = [pa.array(ids, pa.int64(), mask=none == 1), *(pa.array(np.concatenate([o[i] for o in out])) for i in (1, 2))]
            return pa.RecordBatch.from_arrays(columns, names=["post_id", "claim_id", "score"])

        def indexed(rows: list) -> list[np.ndarray]:
            article, claim, score = (np.concatenate(m) for m in zip(*rows))
            order = np.argsort(article, kind="stable")
            names, first, size = np.unique(article[order], return_index=True, return_counts=True)
            return [names, first, first + size, claim[order], score[order]]

        def finish():
            nonlocal post, reads, n
            if post is not None and links:
                found = best(links, np.concatenate(reads))
                if len(found[0]):
                    out.append((post, *found))
                    n += len(found[0])
            post, reads = None, []

        for batch in batches:
            *keys, ids, article, score = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("pb", "cb", "kind", "none", "id", "article", "score"))
            keys = np.stack([*keys, np.where(keys[2] == 1, ids, 0)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                pb, cb, kind, none, id_ = keys[a].tolist()
                if (pb, cb) != cell:
                    finish()
                    cell, links = (pb, cb), []
                if kind == 0:
                    links.append((article[a:b], ids[a:b], score[a:b]))
                    continue
                if links and isinstance(links[0], tuple):
                    links = indexed(links)
                if post != (none, id_):
                    finish()
                    post = (none, id_)
                reads.append(article[a:b])
                if n >= most_rows:
                    yield table()
                    out, n = [], 0
        finish()
        if out:
            yield table()

    return run


def best_links(*tables: DataFrame, key: str = "post_id") -> DataFrame:
    """Best score per (post, claim) over direct links and links through articles."""
    out = tables[0].select(key, "claim_id", "score")
    for t in tables[1:]:
        out = out.unionByName(t.select(key, "claim_id", "score"))
    return out.groupBy(key, "claim_id").agg(F.max("score").alias("score"))


class Linked(NamedTuple):
    """All links of posts: those that are scored when asked for, and those through articles."""

    direct: Scored
    via: Via

    def above(self, threshold: float) -> Linked:
        return Linked(self.direct.above(threshold), self.via._replace(article_links=self.via.article_links.filter(F.col("score") > threshold)))

    def among(self, claims: DataFrame) -> Linked:
        near = self.via.article_links.join(claims.select("claim_id"), "claim_id", "left_semi")
        return Linked(self.direct.among(claims=claims), self.via._replace(article_links=near))

    def pairs(self) -> DataFrame:
        """``(post_id, claim_id, score)``: the best score per pair. A post that reads no article has its pairs from
        the linker alone, as they come; only those of the others are grouped."""
        alone = self.direct.among(items=self.via.post_article, how="left_anti").pairs()
        direct = self.direct.among(items=self.via.post_article).rows()
        return alone.unionByName(best_links(direct, best_via(self.via)))


def posts_of(links: DataFrame, via: Via | None = None) -> DataFrame:
    """``(post_id, score)``: the posts of ``links(post_id, score)`` and, over their articles, of
    ``via.article_links(article_id, score)``; the best score of each article stands for all its links."""
    out = links.select("post_id", "score")
    if via is not None:
        best = via.article_links.groupBy("article_id").agg(F.max("score").alias("score"))
        out = out.unionByName(via.post_article.join(best, "article_id").select("post_id", "score"))
    return out.groupBy("post_id").agg(F.max("score").alias("score"))


def linked_posts(
    links: DataFrame | Scored, has_label: DataFrame, threshold: float = LINK_THRESHOLD, via: Via | None = None
) -> DataFrame:
    """``(post_id, relevance)``: best score above the threshold over labelled claims, of ``links`` and of ``via``."""
    labelled = has_label.select("claim_id").distinct()

    def wanted(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("score") > threshold).join(labelled, "claim_id", "left_semi")

    over = None if via is None else Via(via.post_article, wanted(via.article_links))
    direct = links.above(threshold).among(claims=labelled).best("post_id") if isinstance(links, Scored) else wanted(links)
    return posts_of(direct, over).withColumnRenamed("score", "relevance")


def linked_claims(claims: DataFrame, links: DataFrame) -> DataFrame:
    """Claims that have at least one link."""
    return claims.join(links.select("claim_id"), "claim_id", "left_semi")
