"""Scale ladder: python tools/ladder.py ROWS_OF_ONE_LONG_SERIES NUMBER_OF_SHORT_SERIES [step ...].

Makes a panel of one long series and many short ones (2,000 rows each, or ROWS_EACH of the environment),
each with two variables of its own names in the completion step, and times single steps.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tidepanel import build_session, materialize  # noqa: E402
from tidepanel.operators import clean, decompose, detect, fitted, forecast, iforest, quality, scorers, season  # noqa: E402
from tidepanel.operators import stationarity as unit_root  # noqa: E402
from tidepanel.operators import windows  # noqa: E402
from tidepanel.operators.layout import Layout, exact_quantiles, with_position  # noqa: E402


def main() -> None:
    long_rows, short = int(sys.argv[1]), int(sys.argv[2])
    wanted = sys.argv[3:]
    spark = build_session(
        "ladder",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "32",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    one = spark.range(long_rows).select(F.lit("long").alias("series_id"), F.col("id").alias("i"))
    each = int(os.environ.get("ROWS_EACH", "2000"))
    many = spark.range(short * each).select(
        F.concat(F.lit("s"), F.floor(F.col("id") / each)).alias("series_id"), (F.col("id") % each).alias("i")
    )
    noise = (F.xxhash64("series_id", "i") % 1000003) / 1000003.0
    value = F.sin(F.col("i") * 0.2618) + noise + F.when(F.col("i") % 9973 == 0, 9.0).otherwise(0.0)
    rows = one.unionByName(many).select(
        "series_id",
        F.lit("v").alias("variable"),
        F.timestamp_add("MINUTE", F.col("i"), F.expr("TIMESTAMP_NTZ'2000-01-01 00:00:00'")).alias("ts"),
        F.when(F.xxhash64("i", "series_id") % 10 != 0, value).alias("value"),
    )

    def step(name, run):
        if wanted and name not in wanted and name not in ("panel", "regularise"):
            return None
        start = time.perf_counter()
        out = run()
        print(f"{name:12s} {time.perf_counter() - start:8.2f} s", flush=True)
        return out

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    raw = step("panel", lambda: materialize(rows))
    layout = Layout.measure(raw)
    print("largest group", layout.max_group_rows, "blocked", layout.blocked)
    full = step("regularise", lambda: materialize(clean.regularise(raw, "min", layout)))
    own = raw.withColumn("variable", F.concat(F.lit("a of "), "series_id"))
    half = own.where(F.col("value") > 0).withColumn("variable", F.concat(F.lit("b of "), "series_id"))
    step("complete", lambda: drain(clean.complete(own.unionByName(half), layout)))
    codes = raw.groupBy("series_id").agg(F.lit("2min").alias("freq"), F.lit(2).alias("n_gaps"))
    step("manygrids", lambda: drain(clean.regularise_many(with_position(raw, layout), codes, layout)))
    step("position", lambda: drain(with_position(raw, layout)))
    step("fill", lambda: drain(clean.fill(with_position(raw, layout), layout=layout)))
    step("frequency", lambda: drain(quality.infer_frequency(raw.select("series_id", "ts"), layout)))
    step("rolling", lambda: drain(windows.rolling_features(full, layout)))
    step("quantiles", lambda: drain(exact_quantiles(full, "value", [0.25, 0.5, 0.95], layout)))
    step("period", lambda: drain(season.estimate_period(full, layout=layout)))
    step("unitroot", lambda: drain(unit_root.adf(full, layout=layout)))
    periods = full.groupBy("series_id", "variable").agg(F.lit(24).alias("period"))
    step("stl", lambda: drain(decompose.stl(full, periods, layout=layout)[0]))
    rest = step("residuals", lambda: materialize(forecast.residuals(full, 0.3, layout=layout)))
    if rest is not None:
        step("wasserstein", lambda: drain(scorers.wasserstein_scores(rest, layout)))
        step("kmeans", lambda: drain(scorers.kmeans_scores(rest, layout)))
    model = step("fit", lambda: fitted.fit(full, ["norm", "wasserstein"], layout=layout))
    if model is not None:
        step("score", lambda: drain(fitted.score(full, model, layout)[0]))
    step("detect", lambda: drain(detect.detect(full, 0.3, ["norm", "wasserstein"], layout=layout).combined))
    step("forest", lambda: drain(iforest.detect_isolation_forest(full, trees=50, layout=layout)))


if __name__ == "__main__":
    main()
