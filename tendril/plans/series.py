"""Queries on ordered series: growth events, gaps, intervals, pivots, error curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendril.functions import moments as M
from tendril.functions import ordered as O
from tendril.operators import consistency as C
from tendril.operators import statistics as S
from tendril.plans.registry import query
from tendril.plans.scene import table

DAILY = """
daily AS (
  SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS t, sum(value) AS len,
         count(*) AS n, bool_or(event_type = 'error') AS err
  FROM events GROUP BY 1, 2)
"""


def daily(spark, d):
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    return table(spark, d, "events").groupBy("user_id", day.alias("t")).agg(
        F.sum("value").alias("length"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("event_type") == "error").alias("err")
    )


def daily_lengths(spark, d):
    """Sums of each day in order of the events: speeds of exactly 25 would fall on either side by the order of a sum."""
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    events = table(spark, d, "events").select("user_id", day.alias("t"), "event_id", "value")
    return O.sums_in_order(events, ["user_id", "t"], "event_id", "value", "length"), events.agg(F.max("t"))


SPEED = "WITH" + DAILY + """,
life AS (SELECT user_id, min(t) AS a, max(t) AS b FROM daily GROUP BY user_id),
pad AS (
  SELECT user_id, t, len FROM daily
  UNION ALL SELECT user_id, a - 1, 0.0 FROM life WHERE a <> 0
  UNION ALL SELECT user_id, b + 1, 0.0 FROM life WHERE b < (SELECT max(t) FROM daily)),
sp0 AS (SELECT user_id, t, lag(len) OVER (PARTITION BY user_id ORDER BY t) - len AS v FROM pad),
sp AS (SELECT user_id, t, v FROM sp0 WHERE v IS NOT NULL)
"""


@query(
    "speed_events",
    SPEED + """
    SELECT user_id, count(v) AS n_events, round(avg(abs(v)), 6) AS speed_mean, round(stddev_pop(abs(v)), 6) AS speed_std,
      count(CASE WHEN abs(v) > 25 THEN 1 END) AS n_filtered,
      round(avg(CASE WHEN abs(v) > 25 THEN abs(v) END), 6) AS filtered_mean,
      round(stddev_pop(CASE WHEN abs(v) > 25 THEN abs(v) END), 6) AS filtered_std,
      count(CASE WHEN v < -25 THEN 1 END) AS n_extensions, round(avg(CASE WHEN v < -25 THEN abs(v) END), 6) AS extension_mean,
      round(stddev_pop(CASE WHEN v < -25 THEN abs(v) END), 6) AS extension_std,
      count(CASE WHEN v > 25 THEN 1 END) AS n_retractions, round(avg(CASE WHEN v > 25 THEN v END), 6) AS retraction_mean,
      round(stddev_pop(CASE WHEN v > 25 THEN v END), 6) AS retraction_std,
      round(sqrt(greatest(avg(CASE WHEN v > 25 THEN v * v END) - 2 * avg(CASE WHEN v < -25 THEN abs(v) END) * avg(CASE WHEN v > 25 THEN v END)
        + avg(CASE WHEN v < -25 THEN abs(v) END) * avg(CASE WHEN v < -25 THEN abs(v) END), 0)), 5) AS retraction_std_compat,
      count(CASE WHEN abs(v) <= 25 THEN 1 END) AS n_static, round(count(CASE WHEN abs(v) <= 25 THEN 1 END) / count(v), 6) AS static_share
    FROM sp GROUP BY user_id
    """,
)
def speed_events(spark, d):
    lengths, last = daily_lengths(spark, d)
    out = S.speed_table(S.speeds(lengths, ["user_id"], last), ["user_id"], 25.0)
    cols = [c for c, k in out.dtypes if k == "double"]
    return out.select(*[F.round(c, 5 if c.endswith("compat") else 6).alias(c) if c in cols else F.col(c) for c in out.columns])


@query(
    "speed_classes",
    SPEED + """
    SELECT CASE WHEN abs(v) <= 25 THEN 'static' WHEN v < 0 THEN 'extension' ELSE 'retraction' END AS class, t,
      count(*) AS n, round(sum(v), 4) AS total FROM sp GROUP BY 1, 2
    """,
)
def speed_classes(spark, d):
    lengths, last = daily_lengths(spark, d)
    ev = S.speeds(lengths, ["user_id"], last)
    return ev.groupBy(S.speed_class("speed", 25.0).alias("class"), "t").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("speed"), 4).alias("total")
    )


@query(
    "step_coverage",
    "WITH" + DAILY + """
    SELECT user_id, min(t) AS min_t, max(t) AS max_t, count(*) AS n_steps, count(CASE WHEN n > 1 THEN 1 END) AS n_duplicate,
      CAST(max(t) - min(t) + 1 - count(*) AS BIGINT) AS n_missing FROM daily GROUP BY user_id
    """,
)
def step_coverage(spark, d):
    ev = table(spark, d, "events").select("user_id", F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("t"))
    return C.step_coverage(ev, ["user_id"])


@query(
    "turn_coverage",
    """
    SELECT conv_id, min(turn) AS min_t, max(turn) AS max_t, count(DISTINCT turn) AS n_steps,
      CAST(0 AS BIGINT) + (SELECT count(*) FROM (SELECT turn FROM conversations c WHERE c.conv_id = k.conv_id GROUP BY turn HAVING count(*) > 1)) AS n_duplicate,
      max(turn) - min(turn) + 1 - count(DISTINCT turn) AS n_missing
    FROM conversations k GROUP BY conv_id
    """,
)
def turn_coverage(spark, d):
    return C.step_coverage(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn").withColumn(
        "n_missing", F.col("n_missing").cast("bigint")
    )


@query(
    "interval_fill",
    "WITH" + DAILY + """,
    s AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM daily WHERE err GROUP BY user_id)
    SELECT d.user_id, d.t, coalesce(d.t BETWEEN lo AND hi, false) AS filled FROM daily d LEFT JOIN s USING (user_id)
    """,
)
def interval_fill(spark, d):
    return C.interval_fill(daily(spark, d), ["user_id"], "t", F.col("err")).select("user_id", "t", "filled")


@query(
    "flag_gaps",
    "WITH" + DAILY + """
    SELECT user_id, min(t) AS lo, max(t) AS hi, count(*) AS n FROM daily WHERE err GROUP BY user_id HAVING max(t) - min(t) + 1 <> count(*)
    """,
)
def flag_gaps(spark, d):
    return (
        daily(spark, d).filter("err").groupBy("user_id")
        .agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n"))
        .filter("hi - lo + 1 <> n")
    )


@query(
    "subtrack_ends",
    "WITH" + DAILY + """
    SELECT user_id, t, NOT EXISTS (SELECT 1 FROM daily p WHERE p.user_id = d.user_id AND p.t = d.t - 1) AND t > (SELECT min(t) FROM daily) AS is_start,
      NOT EXISTS (SELECT 1 FROM daily p WHERE p.user_id = d.user_id AND p.t = d.t + 1) AND t < (SELECT max(t) FROM daily) AS is_end
    FROM daily d
    """,
)
def subtrack_ends(spark, d):
    return C.track_ends(daily(spark, d).select("user_id", "t"), ["user_id"])


@query(
    "length_pivot",
    "WITH" + DAILY + """
    SELECT user_id, """ + ", ".join(f"round(max(CASE WHEN t = {s} THEN len END), 6) AS length_t{s:02d}" for s in range(30)) + """
    FROM daily GROUP BY user_id
    """,
)
def length_pivot(spark, d):
    lengths = daily(spark, d).select(F.lit("events").alias("graph_id"), F.col("user_id").alias("object_id"), "t", F.round("length", 6).alias("length"))
    return S.length_pivot(lengths, list(range(30))).drop("graph_id").withColumnRenamed("object_id", "user_id")


NUMBERED = """
numbered AS (
  SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS INT) AS i,
    epoch_us(ts) / 3600e6 - 473352 AS h, value FROM events)
"""


def numbered_events(spark, d):
    """Events numbered per user in order of time, by a parallel sort."""
    ev = table(spark, d, "events").select("user_id", "ts", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 3600e6 - 473352).alias("h"))
    return S.dense_ids(ev, ["user_id"], "ts", "i").withColumn("i", F.col("i").cast("int"))


@query(
    "cumulative_path",
    "WITH" + NUMBERED + """,
    seg AS (SELECT *, sqrt((h - lag(h) OVER w) * (h - lag(h) OVER w) + (value - lag(value) OVER w) * (value - lag(value) OVER w)) AS s
            FROM numbered WINDOW w AS (PARTITION BY user_id ORDER BY i))
    SELECT user_id, i, round(sum(coalesce(s, 0)) OVER (PARTITION BY user_id ORDER BY i), 5) AS along FROM seg
    """,
)
def cumulative_path(spark, d):
    steps = O.neighbours(numbered_events(spark, d), ["user_id"], "i", ["h", "value"], back="p")
    from tendril.operators.graph import sum_of_squares

    seg = F.coalesce(F.sqrt(sum_of_squares("h", "value")), F.lit(0.0))
    return O.running_sums(steps.select("user_id", "i", seg.alias("s")), ["user_id"], "i", {"along": F.col("s")}).select(
        "user_id", "i", F.round("along", 5).alias("along")
    )


@query(
    "polyline_length",
    "WITH" + NUMBERED + """,
    seg AS (SELECT *, sqrt((h - lag(h) OVER w) * (h - lag(h) OVER w) + (value - lag(value) OVER w) * (value - lag(value) OVER w)) AS s
            FROM numbered WINDOW w AS (PARTITION BY user_id ORDER BY i))
    SELECT user_id, round(sum(coalesce(s, 0)), 4) AS length FROM seg GROUP BY user_id
    """,
)
def polyline_length(spark, d):
    from tendril.operators.graph import edge_lengths

    pts = numbered_events(spark, d).select(
        F.lit("events").alias("graph_id"), F.col("user_id").alias("e"), F.col("i").alias("ord"), F.col("h").alias("x"), F.col("value").alias("y"), F.lit(0.0).alias("z")
    )
    return edge_lengths(pts).select(F.col("e").alias("user_id"), F.round("length", 4).alias("length"))


@query(
    "discrete_tangent",
    "WITH" + NUMBERED + """
    SELECT user_id, i, round(coalesce(lead(h) OVER w, h) - coalesce(lag(h) OVER w, h), 6) AS dh,
      round(coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value), 6) AS dv
    FROM numbered WINDOW w AS (PARTITION BY user_id ORDER BY i)
    """,
)
def discrete_tangent(spark, d):
    """Forward difference at the first point, backward at the last, central between."""
    n = O.neighbours(numbered_events(spark, d), ["user_id"], "i", ["h", "value"], back="b", ahead="a")
    diff = lambda c: F.round(F.coalesce(F.col(f"a.{c}"), F.col(c)) - F.coalesce(F.col(f"b.{c}"), F.col(c)), 6)
    return n.select("user_id", "i", diff("h").alias("dh"), diff("value").alias("dv"))


@query(
    "moving_average",
    "WITH" + NUMBERED + """
    SELECT user_id, i, round(CASE WHEN i < 2 OR i > max(i) OVER (PARTITION BY user_id) - 2 THEN value
      ELSE avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS smooth
    FROM numbered
    """,
)
def moving_average(spark, d):
    """Five-point mean; the two samples at either end stay as they are."""
    base = numbered_events(spark, d).select("user_id", "i", "value")
    return O.moving_mean(base, ["user_id"], "i", "value", 2, "smooth").select("user_id", "i", F.round("smooth", 6).alias("smooth"))


@query(
    "opacity_hit",
    "WITH" + NUMBERED + """,
    t AS (SELECT user_id, i, 1 - exp(sum(ln(1 - value / 500)) OVER (PARTITION BY user_id ORDER BY i)) AS opacity FROM numbered)
    SELECT user_id, min(i) AS i, round(arg_min(opacity, i), 6) AS opacity FROM t WHERE opacity > 0.5 GROUP BY user_id
    """,
)
def opacity_hit(spark, d):
    ev = numbered_events(spark, d).select("user_id", "i", (F.col("value") / 500).alias("alpha"))
    return O.opacity_hit(ev, ["user_id"], "i", "alpha").withColumn("opacity", F.round("opacity", 6))


@query(
    "first_past_threshold",
    "WITH" + NUMBERED + """
    SELECT user_id, min(i) AS i, arg_min(value, i) AS value FROM numbered WHERE value > 100 GROUP BY user_id
    """,
)
def first_past_threshold(spark, d):
    return O.first_where(numbered_events(spark, d), ["user_id"], "i", F.col("value") > 100, ["value"])


SUMS = """
sums AS (
  SELECT user_id, i, sum(1.0) OVER w AS n, sum(CAST(i AS DOUBLE)) OVER w AS sx, sum(value) OVER w AS sy, sum(CAST(i AS DOUBLE) * i) OVER w AS sxx,
    sum(i * value) OVER w AS sxy, sum(value * value) OVER w AS syy,
    count(*) OVER (PARTITION BY user_id) AS nn, sum(value) OVER (PARTITION BY user_id) AS ty, sum(value * value) OVER (PARTITION BY user_id) AS tyy
  FROM numbered WINDOW w AS (PARTITION BY user_id ORDER BY i)),
err AS (
  SELECT user_id, i, nn, (greatest(0, syy - sy * sy / n - CASE WHEN n > 1 THEN (sxy - sx * sy / n) * (sxy - sx * sy / n) / (sxx - sx * sx / n) ELSE 0 END)
    + greatest(0, tyy - syy - (ty - sy) * (ty - sy) / (nn - n))) / nn AS e
  FROM sums WHERE i + 1 >= 2 AND i + 1 <= nn - 2)
"""


@query(
    "best_split",
    "WITH" + NUMBERED + "," + SUMS + """
    SELECT u.user_id, coalesce(s.i, -1) AS split, s.e AS error FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (
      SELECT user_id, CAST(arg_min(i, e) AS INT) AS i, round(min(e), 5) AS e FROM err WHERE e > 3000 GROUP BY user_id) s USING (user_id)
    """,
)
def best_split(spark, d):
    return O.best_split(numbered_events(spark, d), ["user_id"], "i", "value", 3000.0).withColumn("error", F.round("error", 5))


@query(
    "line_and_constant_fit",
    """
    SELECT event_type, count(*) AS n, round(regr_syy(value, user_id) - regr_sxy(value, user_id) * regr_sxy(value, user_id) / regr_sxx(value, user_id), 2) AS line_sse,
      round(regr_syy(value, user_id), 2) AS constant_sse FROM events GROUP BY event_type
    """,
)
def line_and_constant_fit(spark, d):
    x, y = F.col("user_id").cast("double"), F.col("value")
    s = table(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy")
    )
    return s.select(
        "event_type", "n", F.round(M.line_sse("n", "sx", "sy", "sxx", "sxy", "syy"), 2).alias("line_sse"), F.round(M.constant_sse("n", "sy", "syy"), 2).alias("constant_sse")
    )


@query(
    "gaussian_moments",
    """
    WITH m AS (
      SELECT l_returnflag AS flag, sum(l_quantity * l_discount) / sum(l_quantity) AS mx, sum(l_quantity * l_tax) / sum(l_quantity) AS my,
        sqrt(sum(l_quantity * l_discount * l_discount) / sum(l_quantity) - pow(sum(l_quantity * l_discount) / sum(l_quantity), 2)) AS sx,
        sqrt(sum(l_quantity * l_tax * l_tax) / sum(l_quantity) - pow(sum(l_quantity * l_tax) / sum(l_quantity), 2)) AS sy, max(l_quantity) AS peak
      FROM lineitem GROUP BY 1)
    SELECT flag, round(any_value(mx), 6) AS mean_x, round(any_value(my), 6) AS mean_y, round(any_value(sx), 6) AS sigma_x, round(any_value(sy), 6) AS sigma_y,
      any_value(peak) AS peak,
      round(sqrt(sum(pow(peak * exp(-0.5 * (pow((l_discount - mx) / sx, 2) + pow((l_tax - my) / sy, 2))) - l_quantity, 2))), 3) AS residual
    FROM lineitem JOIN m ON flag = l_returnflag GROUP BY flag
    """,
)
def gaussian_moments(spark, d):
    from tendril.functions.geometry import gaussian2d

    li = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    fit = li.groupBy(F.col("l_returnflag").alias("flag")).agg(
        M.weighted_mean("l_quantity", "l_discount").alias("mean_x"), M.weighted_mean("l_quantity", "l_tax").alias("mean_y"),
        M.weighted_sigma("l_quantity", "l_discount").alias("sigma_x"), M.weighted_sigma("l_quantity", "l_tax").alias("sigma_y"),
        F.max("l_quantity").alias("peak"),
    )
    g = gaussian2d("l_discount", "l_tax", "mean_x", "mean_y", "sigma_x", "sigma_y", "peak") - F.col("l_quantity")
    res = li.join(fit, F.col("l_returnflag") == F.col("flag")).groupBy("flag").agg(F.sqrt(F.sum(g * g)).alias("residual"))
    return fit.join(res, "flag").select(
        "flag", *[F.round(c, 6).alias(c) for c in ("mean_x", "mean_y", "sigma_x", "sigma_y")], "peak", F.round("residual", 3).alias("residual")
    )


@query(
    "matching_score",
    """
    SELECT event_type, count(*) AS n, round(count(*) / least(count(*), count(DISTINCT user_id)) * exp(-0.01 * sqrt(sum(value * value) / count(*))), 6) AS score
    FROM events GROUP BY event_type
    """,
)
def matching_score(spark, d):
    s = table(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * F.col("value")).alias("ss"), F.count_distinct("user_id").alias("u")
    )
    return s.select("event_type", "n", F.round(M.matching_score("n", "ss", "n", "u", "min", 0.01), 6).alias("score"))


@query(
    "template_step",
    "WITH" + DAILY + """
    SELECT a.user_id, a.t, greatest(0, a.t - 5) AS template_t, round(b.len, 6) AS template_length
    FROM daily a LEFT JOIN daily b ON a.user_id = b.user_id AND b.t = greatest(0, a.t - 5)
    """,
)
def template_step(spark, d):
    """Each step paired with the template five steps earlier (never before step 0)."""
    a = daily(spark, d).select("user_id", "t").withColumn("template_t", F.greatest(F.lit(0), F.col("t") - 5))
    b = daily(spark, d).select("user_id", F.col("t").alias("template_t"), F.round("length", 6).alias("template_length"))
    return a.join(b, ["user_id", "template_t"], "left").select("user_id", "t", "template_t", "template_length")


@query(
    "influence_area",
    "WITH" + DAILY + """
    SELECT d.user_id, d.t, (SELECT max(p.t) FROM daily p WHERE p.user_id = d.user_id AND p.err AND p.t < d.t) AS prior_edit,
      (SELECT min(p.t) FROM daily p WHERE p.user_id = d.user_id AND p.err AND p.t > d.t) AS next_edit
    FROM daily d
    """,
)
def influence_area(spark, d):
    """Steps of the nearest edits before and after each step; one row per user and step."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t")
    mark = F.when(F.col("err"), F.col("t"))
    return daily(spark, d).select(
        "user_id", "t",
        F.max(mark).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prior_edit"),
        F.min(mark).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next_edit"),
    )


@query(
    "joined_ids",
    """
    SELECT user_id, string_agg(CAST(t AS VARCHAR), ', ' ORDER BY t) AS steps FROM (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t FROM events) GROUP BY user_id
    """,
)
def joined_ids(spark, d):
    """Steps of each user as text; at most one entry per step, so a bounded string."""
    return daily(spark, d).groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda i: i.cast("string")), ", ").alias("steps")
    )
