"""Marts and serving tables: comparisons, rankings, evaluation, histograms, leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfline.functions import text as X
from shelfline.operators.ranks import positions
from shelfline.operators.relational import latest_snapshot
from shelfline.operators.warehouse import mean
from shelfline.staging import staged


def _spread(col: str, name: str) -> list[Column]:
    return [X.round_half_up(mean(F.col(col)), 2).alias(f"avg_{name}"), F.min(col).alias(f"min_{name}"), F.max(col).alias(f"max_{name}")]


def _at_latest(comparison: DataFrame, latest: bool = True) -> DataFrame:
    """Rows of the latest month; latest=False: the rows given are of one month already (as Snapshots.read_last gives them)."""
    return latest_snapshot(comparison, F.col("scrape_month")) if latest else comparison


def price_by_brand(comparison: DataFrame, latest: bool = True) -> DataFrame:
    prices = [*_spread("avg_price_per_100ml", "price_per_100ml"), *_spread("avg_price_eur", "price_eur")]
    return _at_latest(comparison, latest).groupBy("brand", "scrape_month").agg(F.countDistinct("global_product_id").alias("product_count"), F.countDistinct("shop_name").alias("shop_count"), *prices)


def price_by_shop(comparison: DataFrame, latest: bool = True) -> DataFrame:
    prices = [*_spread("avg_price_per_100ml", "price_per_100ml"), *_spread("avg_price_eur", "price_eur")]
    return _at_latest(comparison, latest).groupBy("shop_name", "scrape_month").agg(F.countDistinct("global_product_id").alias("product_count"), F.countDistinct("brand").alias("brand_count"), *prices)


def shop_stats(comparison: DataFrame, latest: bool = True) -> DataFrame:
    return _at_latest(comparison, latest).groupBy("shop_name").agg(F.countDistinct("global_product_id").alias("product_count"), *_spread("avg_price_eur", "price")).orderBy("avg_price", "shop_name")


def price_rows(comparison: DataFrame) -> DataFrame:
    """Serving rows: no nulls in addresses, month as text, whole numbers, in order."""
    return comparison.select(
        "global_product_id",
        "shop_name",
        F.coalesce("product_url", F.lit("")).alias("product_url"),
        X.month_text(F.col("scrape_month")).alias("scrape_month"),
        "brand",
        "product_name",
        F.col("volume_ml").cast("long").alias("volume_ml"),
        F.col("shop_count").cast("long").alias("shop_count"),
        *(X.round_half_up(F.col(c), 2).alias(c) for c in ("min_price_eur", "max_price_eur", "avg_price_eur", "avg_price_per_100ml")),
    ).orderBy("scrape_month", F.desc("avg_price_eur"), "global_product_id", "shop_name")


def scorecards(comparison: DataFrame, latest: bool = True) -> DataFrame:
    """One row; noughts when there are no rows. `shops` is the largest number of shops of one product."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return _at_latest(comparison, latest).agg(
        zero(X.round_half_up(mean(F.col("avg_price_eur")), 2)).alias("avg_price"),
        zero(F.min("min_price_eur")).alias("cheapest"),
        zero(F.max("max_price_eur")).alias("most_expensive"),
        F.count("*").alias("products"),
        F.coalesce(F.max("shop_count"), F.lit(0)).alias("shops"),
        F.countDistinct("global_product_id").alias("distinct_products"),
        F.countDistinct("shop_name").alias("distinct_shops"),
        F.coalesce(X.month_text(F.max("scrape_month")), F.lit("—")).alias("last_updated"),
    )


def latest_price_per_product(comparison: DataFrame) -> DataFrame:
    """Each product's price at its last month, the highest where it has several; dearest first."""
    best = comparison.groupBy("product_name").agg(F.max(F.struct("scrape_month", "avg_price_eur")).alias("r"))
    return best.select("product_name", F.col("r.scrape_month").alias("scrape_month"), F.col("r.avg_price_eur").alias("price")).orderBy(F.desc("price"), "product_name")


def top_products(comparison: DataFrame, n: int = 10) -> DataFrame:
    """The n dearest products, and how many more there are."""
    ranked = latest_price_per_product(comparison)
    total = ranked.agg(F.count("*").alias("_all"))
    return ranked.limit(n).crossJoin(F.broadcast(total)).select("product_name", "price", F.greatest(F.col("_all") - n, F.lit(0)).alias("hidden"))


def rank_shops(comparison: DataFrame, latest: bool = True) -> DataFrame:
    """Position of each shop by mean price, the cheapest first."""
    stats = _at_latest(comparison, latest).groupBy("shop_name").agg(X.round_half_up(mean(F.col("avg_price_eur")), 2).alias("avg_price"))
    return positions(stats, [F.col("avg_price"), F.col("shop_name")]).select("shop_name", "avg_price", F.col("position").cast("int").alias("position"))


def best_pick(df: DataFrame, value: str, by: str) -> DataFrame:
    """The row's name with the largest score; ties to the smallest name."""
    return df.agg(F.min_by(value, F.struct(-F.col(by), value)).alias(value), F.max(by).alias(by))


def market_snapshot(comparison: DataFrame, latest: bool = True) -> DataFrame:
    """Per shop: mean price, products, price range; beside the market's figures."""
    rows = _at_latest(comparison, latest)
    # Each shop and the whole market by one scan; a row for each shop, and one more, are written.
    avg, ends = X.round_half_up(mean(F.col("avg_price_eur")), 2).alias("avg_price"), (F.min("min_price_eur").alias("_low"), F.max("max_price_eur").alias("_high"))
    counts = [F.countDistinct(c).alias(n) for c, n in (("global_product_id", "products"), ("brand", "_brands"), ("_shop", "_shops"))]
    sets = rows.withColumn("_shop", F.col("shop_name")).groupingSets([["shop_name"], []], "shop_name").agg(F.grouping("shop_name").alias("_all"), avg, *counts, *ends)
    told = staged(sets, "market")
    whole = told.filter("_all = 1").select(F.col("avg_price").alias("market_avg"), F.col("products").alias("market_products"), F.col("_brands").alias("market_brands"), F.col("_shops").alias("market_shops"))
    price_range = F.concat(F.format_string("%.2f", "_low"), F.lit(" – "), F.format_string("%.2f", "_high"))
    return told.filter("_all = 0").select("shop_name", "avg_price", "products", price_range.alias("price_range")).crossJoin(F.broadcast(whole))  # one row


def shop_origin_first(df: DataFrame, order: list[str], shop: str = "shop_name", url: str = "product_url") -> DataFrame:
    """The origin of each shop's first row's address."""
    return df.groupBy(shop).agg(X.url_origin(F.min_by(F.coalesce(url, F.lit("")), F.struct(*order))).alias("origin")).orderBy(shop)


# Evaluation of matches


def confusion_counts(scored: DataFrame, run: str = "computed_at", match: str = "is_match", verdict: str = "ground_truth_verdict") -> DataFrame:
    m, v = F.col(match), F.col(verdict)
    count = lambda c, name: F.count_if(c).alias(name)
    return scored.groupBy(F.col(run).alias("evaluated_at")).agg(
        F.count("*").alias("total_pairs"),
        count(v.isNotNull(), "matched_with_gt"),
        count(v.isNull(), "not_in_gt"),
        count(m & (v == "SAME"), "true_positive"),
        count(m & (v == "DIFFERENT"), "false_positive"),
        count(~m & (v == "SAME"), "false_negative"),
        count(~m & (v == "DIFFERENT"), "true_negative"),
    )


def match_metrics(counts: DataFrame, zero: str = "null") -> DataFrame:
    """counts with coverage, precision, recall, F1 and accuracy; noughts below give null, or 0 (and F1 from P and R)."""
    tp, fp, fn, tn, told = (F.col(c) for c in ("true_positive", "false_positive", "false_negative", "true_negative", "matched_with_gt"))
    end = (lambda c: F.coalesce(c, F.lit(0.0))) if zero == "zero" else (lambda c: c)
    p, r = X.safe_ratio(tp, tp + fp), X.safe_ratio(tp, tp + fn)
    f1 = X.safe_ratio(2.0 * tp, 2.0 * tp + fp + fn) if zero == "null" else X.safe_ratio(2 * end(p) * end(r), end(p) + end(r))
    named = {"gt_coverage_pct": (X.safe_ratio(told * 100.0, F.col("total_pairs")), 1), "precision": (p, 3), "recall": (r, 3), "f1": (f1, 3), "accuracy": (X.safe_ratio(tp + tn, told), 3)}
    return counts.select("*", *(end(X.round_half_up(c, d)).alias(n) for n, (c, d) in named.items()))


def score_histogram(scored: DataFrame, scores: dict[str, str], verdict: str = "ground_truth_verdict", bins: int = 20) -> DataFrame:
    """(metric, bin, verdict, cnt) of several scores in one scan."""
    both = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).alias("x")) for m, c in scores.items())))
    rows = scored.select(both.alias("s"), F.coalesce(verdict, F.lit("UNKNOWN")).alias("verdict"))
    return rows.groupBy(F.col("s.metric").alias("metric"), (F.floor(F.col("s.x") * bins + 0.5) / float(bins)).alias("bin"), "verdict").agg(F.count("*").alias("cnt"))


def cumulative_counts(histogram: DataFrame, verdicts: tuple[str, ...] = ("SAME", "DIFFERENT", "UNKNOWN")) -> DataFrame:
    """Running totals by verdict over the bins of each metric."""
    wide = histogram.groupBy("metric", "bin").agg(*(F.sum(F.when(F.col("verdict") == v, F.col("cnt")).otherwise(0)).alias(v) for v in verdicts))
    w = W.partitionBy("metric").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    return wide.select("metric", "bin", *(F.sum(v).over(w).alias(v) for v in verdicts))


def cumulative_share(histogram: DataFrame, verdicts: tuple[str, ...] = ("SAME", "DIFFERENT", "UNKNOWN")) -> DataFrame:
    """Running totals as shares of 100, to one digit."""
    total = sum((F.col(v) for v in verdicts[1:]), F.col(verdicts[0]))
    return cumulative_counts(histogram, verdicts).select("metric", "bin", *(X.round_half_up(F.try_divide(F.col(v) * 100.0, total), 1).alias(v) for v in verdicts))


def label_progress(todo: DataFrame, labels: DataFrame, keys: list[str], verdict: str = "verdict") -> DataFrame:
    """One row: labels by verdict (unexpected ones count as uncertain), pairs done, remaining and in all. For labels of a table
    of their own; pairs that carry theirs are counted by labelled_progress, in one pass."""
    own = labels.select(*keys, F.when(F.col(verdict).isin("SAME", "DIFFERENT"), F.col(verdict)).otherwise("UNCERTAIN").alias("_v"))
    count = lambda v: F.count_if(F.col("_v") == v).alias(v.lower())
    told = own.agg(count("SAME"), count("DIFFERENT"), count("UNCERTAIN"))
    marked = todo.select(*keys).distinct().join(own.select(*keys, F.lit(1).alias("_done")).distinct(), keys, "left")
    pairs = marked.agg(F.count("_done").alias("done"), F.count_if(F.col("_done").isNull()).alias("remaining"), F.count("*").alias("total"))
    return told.crossJoin(pairs)


def labelled_progress(pairs: DataFrame, verdict: Column) -> DataFrame:
    """label_progress of pairs that carry their label, null for none: tasks count, and nothing else is shuffled or kept."""
    known = verdict.isin("SAME", "DIFFERENT")
    counts = {"same": verdict == "SAME", "different": verdict == "DIFFERENT", "uncertain": ~known, "done": verdict.isNotNull(), "remaining": verdict.isNull(), "total": F.lit(True)}
    return pairs.agg(*(F.count_if(test).alias(name) for name, test in counts.items()))


def component_listing(components: DataFrame, chunk: int = 10_000) -> DataFrame:
    """(root, chunk, members, size) of components of more than one member: members in order, in lists of at most `chunk`.

    Members are placed by ranges of (root, node) over all tasks, so that a component of any size is never gathered in one.
    """
    placed = positions(components.select("root", "node").distinct(), [F.col("root"), F.col("node")], "_at")
    sizes = placed.groupBy("root").agg(F.min("_at").alias("_first"), F.count("*").alias("size")).filter("size > 1")
    cut = placed.join(sizes, "root").withColumn("chunk", F.floor((F.col("_at") - F.col("_first")) / chunk))
    return cut.groupBy("root", "chunk", "size").agg(F.sort_array(F.collect_list("node")).alias("members")).select("root", "chunk", "members", "size")


def star_edges(groups: DataFrame, group: str, member: list[str]) -> DataFrame:
    """(a, b): each group's first member with every other one."""
    node = F.concat_ws("||", *member)
    rows = groups.select(F.col(group).alias("_g"), node.alias("b")).distinct()
    hub = rows.groupBy("_g").agg(F.min("b").alias("a"))
    return rows.join(hub, "_g").filter("a <> b").select("a", "b")


def assign_group_ids(components: DataFrame) -> DataFrame:
    """(node, global_product_id): the version 5 UUID of the component's root."""
    return components.select("node", X.uuid5(F.col("root")).alias("global_product_id"))


# Conversations


def conversation_rollup(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", said: str = "text") -> DataFrame:
    """Per conversation: its history as JSON, the first three user turns as reason, and the last turn's text.

    A conversation's turns are gathered in one row, as its history is one stored value.
    """
    history = F.sort_array(F.collect_list(F.struct(F.col(order).alias("turn"), F.col(role).alias("role"), F.col(said).alias("text"))))
    rows = turns.groupBy(conv).agg(history.alias("h"))
    user = F.transform(F.filter("h", lambda t: t["role"] == "user"), lambda t: t["text"])
    plain = F.transform("h", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.select(conv, F.to_json(plain).alias("conversation_json"), F.array_join(F.slice(user, 1, 3), " / ").alias("reason"), F.element_at("h", -1)["text"].alias("ai_reply"), plain.alias("history"))


def conversation_summary(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", said: str = "text") -> DataFrame:
    """(conv, reason, ai_reply, turns) without the history: the first three user turns, the last turn's text, and their number.
    No list of all turns is made: of a long conversation each task hands on its three first user turns and its last."""
    last = turns.groupBy(conv).agg(F.max_by(said, F.struct(order, role, said)).alias("ai_reply"), F.count("*").alias("turns"))
    w = W.partitionBy(conv).orderBy(order, said)
    first = turns.filter(F.col(role) == "user").withColumn("_n", F.row_number().over(w)).filter("_n <= 3")
    reason = first.groupBy(F.col(conv).alias("_conv")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.col(said).alias("x")))), lambda t: t["x"]), " / ").alias("reason"))
    return last.join(reason, F.col(conv).eqNullSafe(F.col("_conv")), "left").select(conv, F.coalesce("reason", F.lit("")).alias("reason"), "ai_reply", "turns")


def history_chunks(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", said: str = "text", chunk: int = 1000) -> DataFrame:
    """(conv, chunk, history): each conversation's turns in order as JSON lists of at most `chunk` turns, placed by ranges
    over all tasks. A history of at most `chunk` turns is conversation_rollup's."""
    placed = positions(turns.select(conv, order, role, said), [F.col(c).asc_nulls_first() for c in (conv, order, role, said)], "_at")
    first = placed.groupBy(F.col(conv).alias("_conv")).agg(F.min("_at").alias("_first"))
    cut = placed.join(first, F.col(conv).eqNullSafe(F.col("_conv"))).withColumn("chunk", F.floor((F.col("_at") - F.col("_first")) / chunk))
    turn = F.struct(F.col("_at"), F.struct(F.col(role).alias("role"), F.col(said).alias("text")).alias("t"))
    lists = F.transform(F.sort_array(F.collect_list(turn)), lambda x: x["t"])
    return cut.groupBy(conv, "chunk").agg(F.to_json(lists).alias("history"))


# Pixels


def color_histogram(pixels: DataFrame, image: str = "image_id", bins: int = 32, white: int = 200, black: int = 60, least: int = 100) -> DataFrame:
    """(image, histogram) of r, g and b, `bins` each, as shares of all counts.

    Near-white and near-black pixels don't count, unless fewer than `least` would be left.
    """
    r, g, b = (F.col(c) for c in "rgb")
    white_, black_ = (r > white) & (g > white) & (b > white), (r < black) & (g < black) & (b < black)
    step = 256 // bins
    channels = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.floor(v / step).cast("int").alias("v")) for i, v in enumerate((r, g, b)))))
    counts = pixels.select(image, (~white_ & ~black_).alias("kept"), channels.alias("p")).groupBy(image, "p.c", "p.v").agg(F.count_if("kept").alias("own"), F.count("*").alias("whole"))
    table = counts.groupBy(image).agg(F.map_from_entries(F.collect_list(F.struct(F.col("c") * bins + F.col("v"), F.struct("own", "whole")))).alias("m"), F.sum("own").alias("own"), F.sum("whole").alias("whole"))
    few = F.col("own") < 3 * least
    pick = F.transform(F.sequence(F.lit(0), F.lit(3 * bins - 1)), lambda i: F.coalesce(F.when(few, F.try_element_at("m", i)["whole"]).otherwise(F.try_element_at("m", i)["own"]), F.lit(0)).cast("double"))
    total = F.when(few, F.col("whole")).otherwise(F.col("own")) + 1e-9
    return table.select(image, F.transform(pick, lambda x: x / total).alias("histogram"))
