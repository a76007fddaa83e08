"""Label seeds, greedy label propagation, and the cluster-aware split."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.claims import SIZES, is_ruled
from claimweave.operators.components import components
from claimweave.operators.keyed import running_before
from claimweave.operators.linking import Scored, Via
from claimweave.session import cut_lineage

#: Rounds over all seeds before what is left is split into components.
EARLY_ROUNDS = 3
#: As many links of posts are written at most where links are scored anew for each step; while open seeds have more, rounds go on.
MOST_WRITTEN = 10_000_000


def _sizes(sizes: dict[str, float]):
    return F.inline(
        F.array(*[F.struct(F.lit(n).alias("size"), F.lit(float(t)).alias("threshold")) for n, t in sizes.items()])
    )


def agreed_verdicts(reviews: DataFrame) -> DataFrame:
    """``(claim_id, verdict)`` of claims whose misinformation / factual reviews agree."""
    ruled = reviews.filter(is_ruled(F.col("predicted_verdict")))
    seen = ruled.groupBy("claim_id").agg(
        F.min("predicted_verdict").alias("verdict"), F.max("predicted_verdict").alias("_other")
    )
    return seen.filter("verdict = _other").select("claim_id", "verdict")


def label_seeds(links: DataFrame, reviews: DataFrame, sizes: dict[str, float] = SIZES) -> DataFrame:
    """``(size, claim_id, verdict)``: claims with agreeing reviews and a post or article
    link above the threshold of the size.

    ``links(claim_id, score)`` holds the links of posts and of articles. Only the best
    score per claim matters, so all sizes come out of one aggregate.
    """
    best = links.groupBy("claim_id").agg(F.max("score").alias("score"))
    seeds = best.join(agreed_verdicts(reviews), "claim_id")
    return (
        seeds.select("*", _sizes(sizes)).filter("score > threshold").select("size", "claim_id", "verdict")
    )


def _least(tables: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """The least ``value`` per key over all tables."""
    rows = [t.select(*keys, value) for t in tables]
    return reduce(DataFrame.unionByName, rows).groupBy(*keys).agg(F.min(value).alias(value))


class _Shared(NamedTuple):
    """Claims and their posts: ``direct(size, post_id, claim_id, ...)`` and, through articles, ``read(size, article_id,
    claim_id, ...)`` beside ``post_article(post_id, article_id)``. A value that goes from claims to posts or back
    goes over the articles, so the pairs of posts and claims that articles make are not formed."""

    direct: DataFrame
    read: DataFrame | None
    post_article: DataFrame | None

    def each(self, change: Callable[[DataFrame], DataFrame]) -> _Shared:
        return _Shared(change(self.direct), None if self.read is None else change(self.read), self.post_article)

    def rows(self) -> list[DataFrame]:
        return [self.direct] if self.read is None else [self.direct, self.read]

    def on_posts(self, value: str) -> DataFrame:
        """``(size, post_id, value)``: the least ``value`` of the rows of a post."""
        tables = [self.direct]
        if self.read is not None:
            tables.append(_least([self.read], ["size", "article_id"], value).join(self.post_article, "article_id"))
        return _least(tables, ["size", "post_id"], value)

    def from_posts(self, posts: DataFrame, value: str) -> list[DataFrame]:
        """The rows with the least ``value`` of their posts, out of ``posts(size, post_id, value)``."""
        out = [self.direct.join(posts, ["size", "post_id"])]
        if self.read is not None:
            articles = _least([posts.join(self.post_article, "post_id")], ["size", "article_id"], value)
            out.append(self.read.join(articles, ["size", "article_id"]))
        return out

    def written(self) -> _Shared:
        return self.each(cut_lineage)

    def is_empty(self) -> bool:
        return all(t.isEmpty() for t in self.rows())


class _Rescored(NamedTuple):
    """As :class:`_Shared`, with links of posts that are scored anew for each step and never written. Values are claims' ids."""

    links: Scored
    read: DataFrame | None
    post_article: DataFrame | None
    sizes: dict[str, float]

    def on_posts(self, values: DataFrame, value: str) -> DataFrame:
        """``(size, post_id, value)``: the least ``value`` of the claims of a post, of ``values(size, claim_id, value)``."""
        tables = [self.links.least("post_id", values, value, self.sizes)]
        if self.read is not None:
            near = self.read.join(values.select("size", "claim_id", value), ["size", "claim_id"])
            tables.append(_least([near], ["size", "article_id"], value).join(self.post_article, "article_id"))
        return _least(tables, ["size", "post_id"], value)

    def on_claims(self, posts: DataFrame, value: str, among: DataFrame | None = None) -> DataFrame:
        """``(size, claim_id, value)``: the least ``value`` of the posts of a claim, of ``posts(size, post_id, value)``;
        of the claims and sizes ``among`` alone, if given."""
        links = self.links if among is None else self.links.among(claims=among.select("claim_id").distinct())
        tables = [links.least("claim_id", posts, value, self.sizes)]
        if self.read is not None:
            articles = _least([posts.join(self.post_article, "post_id")], ["size", "article_id"], value)
            tables.append(self.read.join(articles, ["size", "article_id"]))
        out = _least(tables, ["size", "claim_id"], value)
        return out if among is None else out.join(among.select("size", "claim_id"), ["size", "claim_id"], "left_semi")

    def rows(self, seeds: DataFrame) -> _Shared:
        """The links of ``seeds(size, claim_id, pri)`` as written tables with ``pri``."""
        mine = seeds.select("size", "claim_id", "pri")
        near = self.links.among(claims=mine.select("claim_id").distinct()).rows()
        direct = _sized(near, "post_id", self.sizes).filter("post_id IS NOT NULL").join(mine, ["size", "claim_id"])
        read = None if self.read is None else self.read.join(mine, ["size", "claim_id"])
        return _Shared(direct, read, self.post_article).written()

    def are_many(self, seeds: DataFrame) -> bool:
        one = seeds.select("claim_id").distinct().select("claim_id", F.lit(0).alias("all"), F.lit(1).alias("n"))
        return (self.links.sums(one, "all", "n").agg(F.sum("n")).first()[0] or 0) > MOST_WRITTEN


def _sized(rows: DataFrame, end: str, sizes: dict[str, float]) -> DataFrame:
    strong = rows.filter(F.col("score") > min(sizes.values())).select(end, "claim_id", "score", _sizes(sizes))
    return strong.filter("score > threshold").select("size", end, "claim_id")


def _rounds(near: _Rescored, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(founders, open)`` after the first rounds over links that are not written, as many as leave open seeds with links
    that may be written. A round passes over the links two or three times and moves one row per post or claim."""
    key = ["size", "claim_id"]
    open_, founders, done = seeds.select(*key, "pri"), None, 0
    while not open_.isEmpty() and (done < EARLY_ROUNDS or near.are_many(open_)):
        first = cut_lineage(near.on_posts(open_, "pri").withColumnRenamed("pri", "first"))
        firsts = near.on_claims(first, "first", open_)
        # The earliest seed of all founds in any case; one without a post founds its own label at once.
        earliest = open_.groupBy("size").agg(F.min("pri").alias("earliest"))
        judged = cut_lineage(open_.join(firsts, key, "left").join(F.broadcast(earliest), "size"))
        new = cut_lineage(judged.filter("first IS NULL OR first = pri OR pri = earliest").select(*key, "pri"))
        rest = judged.join(new, key, "left_anti")
        # Seeds on a post of a new founder are out: most by the least of their posts, the others by any of them.
        heads = new.select("size", F.col("pri").alias("first"))
        rest = cut_lineage(rest.join(heads, ["size", "first"], "left_anti").select(*key, "pri"))
        if not rest.isEmpty():
            taken = first.join(heads, ["size", "first"], "left_semi")
            rest = cut_lineage(rest.join(near.on_claims(taken, "first", rest), key, "left_anti"))
        founders = new if founders is None else founders.unionByName(new)
        open_, done = rest, done + 1
        if done % 20 == 0:
            founders = cut_lineage(founders)
    return seeds.select(*key, "pri").limit(0) if founders is None else founders, open_


def _by_component(state: _Shared, local_rows: int) -> tuple[DataFrame, _Shared]:
    """The state, its rows with ``pri``, split into components: ``(size, root, claim_id, post_id, article_id, pri)`` of those
    of at most ``local_rows`` rows, and the rest as a state. A row is a claim and its post, a claim and its article, or,
    without a claim, an article of the component and a post that reads it; the pairs of claims and readers
    are not formed. Each post and each article links its seeds to its least one, a star and no pairs."""
    def end(claim: str):
        return F.struct("size", F.col(claim).alias("claim_id"))

    def star(rows: DataFrame, to: str = "claim_id") -> DataFrame:
        return rows.select(end(to).alias("a"), end("least").alias("b"))

    least = cut_lineage(state.each(lambda t: t.withColumn("least", F.col("claim_id"))).on_posts("least"))
    stars = star(state.direct.join(least, ["size", "post_id"]))
    if state.read is not None:
        of_article = cut_lineage(state.read.groupBy("size", "article_id").agg(F.min("claim_id").alias("least")))
        stars = stars.union(star(state.read.join(of_article, ["size", "article_id"])))
        heads = of_article.withColumnRenamed("least", "head").join(state.post_article, "article_id")
        stars = stars.union(star(heads.join(least, ["size", "post_id"]), "head").distinct())
    found = components(stars)
    found = found.select("node.size", "node.claim_id", F.col("component.claim_id").alias("root"))
    placed = state.each(
        lambda t: t.join(found, ["size", "claim_id"], "left").withColumn("root", F.coalesce("root", "claim_id"))
    ).written()
    rows = [placed.direct] if state.read is None else [placed.direct, placed.read, _readers(placed)]
    counted = [t.groupBy("size", "root").agg(F.count(F.lit(1)).alias("n")) for t in rows]
    counted = reduce(DataFrame.unionByName, counted).groupBy("size", "root").agg(F.sum("n").alias("n"))
    giant = cut_lineage(counted.filter(F.col("n") > local_rows).select("size", "root"))
    rest = placed.each(lambda t: t.join(giant, ["size", "root"], "left_semi").drop("root"))
    small = placed.each(lambda t: t.join(giant, ["size", "root"], "left_anti"))
    if state.read is None:
        local = small.direct.withColumn("article_id", F.lit(None).cast("bigint"))
    else:
        local = small.direct.unionByName(small.read, True).unionByName(_readers(small), True)
    return local.select("size", "root", "claim_id", "post_id", "article_id", "pri"), rest


def _readers(placed: _Shared) -> DataFrame:
    """``(size, root, article_id, post_id)``: each article of a component once with each of its readers."""
    return placed.read.select("size", "root", "article_id").distinct().join(placed.post_article, "article_id")


class _Taken:
    """What the founders of a component hold: posts, and articles that one of these posts reads."""

    def __init__(self):
        self.readers, self.reads, self.posts, self.articles = {}, {}, set(), set()

    def read(self, article, post) -> None:
        self.readers.setdefault(article, []).append(post)
        self.reads.setdefault(post, []).append(article)

    def found(self, posts: list, articles: list) -> bool:
        """Take all posts of a seed, if none of them is taken."""
        if not (self.posts.isdisjoint(posts) and self.articles.isdisjoint(articles)):
            return False
        for some in (posts, *(self.readers.get(a, ()) for a in articles)):
            for post in some:
                if post not in self.posts:
                    self.posts.add(post)
                    self.articles.update(self.reads.get(post, ()))
        return True


def _first_come(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Founders among seeds that come component by component: first the articles of a component with their readers, then
    the seeds in order, one row per post or article."""
    group, seed, posts, articles, taken, types = None, None, [], [], _Taken(), None

    def founders(found: list) -> pa.RecordBatch:
        columns = list(zip(*found)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["size", "claim_id"])

    for batch in batches:
        types = [batch.schema.field(c).type for c in ("size", "claim_id")]
        found = []
        for size, root, claim, post, article in zip(*(c.to_pylist() for c in batch.columns)):
            if seed is not None and (claim != seed or (size, root) != group):
                if taken.found(posts, articles):
                    found.append((group[0], seed))
                seed, posts, articles = None, [], []
            if (size, root) != group:
                group, taken = (size, root), _Taken()
            if claim is None:
                taken.read(article, post)
                continue
            seed = claim
            if post is not None:
                posts.append(post)
            if article is not None:
                articles.append(article)
        yield founders(found)
    if seed is not None and taken.found(posts, articles):
        yield founders([(group[0], seed)])


def propagate_labels(
    links: DataFrame | Scored,
    seeds: DataFrame,
    sizes: dict[str, float] = SIZES,
    priority: str = "id",
    local_rows: int = 1_000_000,
    via: Via | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Greedy labels: go through the seeds in order; a seed without a label gets its own
    and hands it to every unlabelled claim that shares a post with it.

    ``links(post_id, claim_id, score)``, ``seeds(size, claim_id, verdict)``. Returns
    ``labels(label_id, size, verdict)`` and ``has_label(claim_id, label_id, size)``; the id
    of a label is the claim that founded it. ``via`` adds the claims that a post has through its articles; all
    tables are read several times.

    A seed founds a label exactly when no earlier seed that shares a post with it does, so seeds
    that no chain of posts connects do not touch each other. The first rounds go over all seeds: a seed that
    is the earliest open one on all its posts founds, the open seeds next to it are out. Where many claims share
    posts they leave little. The rest is split into components without a common post;
    one of at most ``local_rows`` rows, articles and their readers included, is settled in order by one task, which reads its
    seeds as a stream and remembers its taken posts and who reads its articles. So a chain of any order costs no further rounds.

    Only larger components go on in rounds. Every round settles the earliest open seed at
    least, so it ends by itself. Each round takes minima per post and then
    per claim, so its cost is linear in the links and no pair of claims is formed, however
    many claims share a post. ``priority='hash'`` orders the seeds at random (repeatably),
    which keeps the number of rounds small there too.

    ``links`` that are :class:`linking.Scored` are not written: the first rounds, and as many more as leave open seeds with few
    links, pass over them, and only what is left is written. They go by id.
    """
    order = F.col("claim_id") if priority == "id" else F.struct(F.xxhash64("claim_id").alias("h"), F.col("claim_id"))
    seeds = cut_lineage(seeds.withColumn("pri", order))
    key = ["size", "claim_id"]

    # A claim without a post touches no other.
    near, post_article = None, None
    if via is not None:
        post_article = cut_lineage(via.post_article.select("post_id", "article_id").dropna().distinct())
        read = via.article_links.join(post_article.select("article_id"), "article_id", "left_semi")
        read = cut_lineage(_sized(read, "article_id", sizes).distinct())
    else:
        read = None
    if isinstance(links, Scored):
        if priority != "id":
            raise ValueError("links that are scored anew are settled by id")
        near = _Rescored(links, read, post_article, sizes)
        early, left = _rounds(near, seeds)
        state = near.rows(left)
    else:
        early, left = None, seeds
        edges = _Shared(_sized(links, "post_id", sizes).filter("post_id IS NOT NULL"), read, post_article)
        state = edges.each(lambda t: t.join(seeds.select(*key, "pri"), key)).written()
    posted = reduce(DataFrame.unionByName, [t.select(*key) for t in state.rows()]).distinct()
    # A seed without a post (linked through articles alone) founds its own label at once.
    founders = left.join(posted, key, "left_anti").select(*key, "pri")
    founders = founders if early is None else founders.unionByName(early)
    done = 0 if early is None else EARLY_ROUNDS
    while not state.is_empty():
        if done == EARLY_ROUNDS:
            local, state = _by_component(state, local_rows)
            in_order = local.repartition("size", "root").sortWithinPartitions(
                "size", "root", F.col("claim_id").isNotNull(), "pri", "claim_id"
            )
            settled = in_order.select("size", "root", "claim_id", "post_id", "article_id")
            first_come = settled.mapInArrow(_first_come, seeds.select(*key).schema)
            founders = founders.unionByName(first_come.join(seeds.select(*key, "pri"), key))
            if state.is_empty():
                break
        first_seed = cut_lineage(state.on_posts("pri").withColumnRenamed("pri", "first"))
        firsts = _least(state.from_posts(first_seed, "first"), [*key, "pri"], "first")
        new = cut_lineage(firsts.filter("first = pri").select(*key, "pri"))
        # Seeds on a post of a new founder are done: the founder itself and its neighbours.
        taken = first_seed.join(new.select("size", F.col("pri").alias("first")), ["size", "first"], "left_semi")
        out = reduce(DataFrame.unionByName, [t.select(*key) for t in state.from_posts(taken, "first")])
        out = cut_lineage(out.distinct())
        state = state.each(lambda t: t.join(out, key, "left_anti")).written()
        founders = founders.unionByName(new)
        done += 1
        if done % 20 == 0:
            founders = cut_lineage(founders)
    founders = cut_lineage(founders)

    # Both tables that meet all links here are written first, so that Spark knows how small they are; founders share no
    # post, so each of them reaches itself alone, and the links need not meet the founders again.
    first = F.col("pri").alias("first")
    if near is not None:
        reached = near.on_claims(cut_lineage(near.on_posts(founders, "pri").withColumnRenamed("pri", "first")), "first")
    else:
        founding = edges.each(lambda t: t.join(founders, key).select(*[c for c in t.columns if c != "claim_id"], first))
        reached = _least(edges.from_posts(cut_lineage(founding.on_posts("first")), "first"), key, "first")
    founder = F.col("first") if priority == "id" else F.col("first").getField("claim_id")
    reached = reached.select(*key, founder.alias("label_id")).filter("claim_id <> label_id")
    own = founders.select(*key, F.col("claim_id").alias("label_id"))
    has_label = own.unionByName(reached).select("claim_id", "label_id", "size")
    labels = founders.join(seeds.select(*key, "verdict"), key).select(
        F.col("claim_id").alias("label_id"), "size", "verdict"
    )
    return labels, has_label


def split_labels(labels: DataFrame, has_label: DataFrame, claims: DataFrame, share: float = 0.1) -> DataFrame:
    """Add ``train_mask, val_mask, test_mask`` to ``labels(label_id, size, ...)``.

    Clusters are taken by ascending number of labels: cluster -1 goes to train, the others
    fill val up to ``share`` of the labels, then test, and the rest is train. A label goes
    where its first cluster goes; one without a clustered claim keeps null masks.
    """
    in_cluster = (
        has_label.join(claims.filter("cluster IS NOT NULL").select("claim_id", "cluster"), "claim_id")
        .select("size", "cluster", "label_id")
        .distinct()
    )
    clusters = cut_lineage(in_cluster.groupBy("size", "cluster").agg(F.count(F.lit(1)).alias("num_labels")))
    # One row per size.
    quota = labels.groupBy("size").agg(F.floor(F.count(F.lit(1)) * share).alias("quota"))
    counted = running_before(
        clusters.filter("cluster <> -1"), ["size"], ["num_labels"], "cluster", F.col("num_labels")
    ).join(F.broadcast(quota), "size")
    val_total = counted.filter("before < quota").groupBy("size").agg(F.sum("num_labels").alias("val_total"))
    part = F.when(F.col("before") < F.col("quota"), F.lit("val")).when(
        F.col("before") - F.coalesce(F.col("val_total"), F.lit(0)) < F.col("quota"), F.lit("test")
    ).otherwise(F.lit("train"))
    placed = counted.join(F.broadcast(val_total), "size", "left").select("size", "cluster", "num_labels", part.alias("part"))
    none = clusters.filter("cluster = -1").select("size", "cluster", "num_labels", F.lit("train").alias("part"))
    first = (
        in_cluster.join(placed.unionByName(none), ["size", "cluster"])
        .groupBy("size", "label_id")
        .agg(F.min_by("part", F.struct("num_labels", "cluster")).alias("part"))
    )
    masks = [(F.col("part") == p).alias(f"{p}_mask") for p in ("train", "val", "test")]
    return labels.join(first, ["size", "label_id"], "left").select(
        *[F.col(c) for c in labels.columns], *masks
    )
