"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.operators import datasets, evaluate, ranking, reports, symbols  # noqa: E402
from barloom.plans import cleaning, features  # noqa: E402
from barloom.session import local_session  # noqa: E402
from barloom.sources.adapters import dirty_bars, events_bars, lineitem_bars, names, symbol_inputs, universe  # noqa: E402
from barloom.sources.writers import scratch_dir, write_parquet  # noqa: E402
from barloom.streaming.averages import RunningAverages  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def sequences_flat(bars):
    rows = bars.selectExpr("*", "IF(Close > Open, 1, 0) AS Target")
    made = datasets.sequences(rows, 60, ["Open", "High", "Low", "Close", "Volume"])
    return made.selectExpr("Symbol", "Date", "label", "flatten(sequence) AS vector")


# Over the bar table written once, as a pipeline would; "bars" is the making of that table.
QUERIES = {
    "strict_features": features.strict_features,
    "strict_features_blocks": lambda bars: features.strict_features(bars, force=True),
    "training_features": features.training_features,
    "batch_features": features.batch_features,
    "batch_summary": lambda bars: reports.summary(features.batch_features(bars)),
    "live_features": features.live_features,
    "sequences": sequences_flat,
    "candle_windows": datasets.candle_windows,
    "correlation_matrix": lambda bars: reports.correlation_matrix(features.recent_live_features(bars, 50)),
    "time_split": ranking.time_split,
    "time_series_folds": ranking.time_series_folds,
    "latest_complete": lambda bars: datasets.latest_complete(features.live_features(bars)),
    "even_sample": datasets.sampled_candle_windows,
    "roc_auc": lambda bars: evaluate.roc_auc(bars.selectExpr("IF(Close > Open, 1, 0) AS y", "(High - Low) / High AS p")),
}


def averages(spark):
    """A stream's batch of all hourly bars through the running averages, in a store of its own."""
    job = RunningAverages(spark, scratch_dir(spark) + "/averages")
    job.step(events_bars(spark, SF_DIR), 0)
    return job.read()


# Over their own inputs.
OTHERS = {
    "bars": lambda spark: lineitem_bars(spark, SF_DIR),
    "live_features_hourly": lambda spark: features.live_features(events_bars(spark, SF_DIR)),
    "clean": lambda spark: cleaning.clean(dirty_bars(spark, SF_DIR), intraday=True),
    "stage_counts": lambda spark: cleaning.stage_counts(dirty_bars(spark, SF_DIR), intraday=True),
    "resolve_symbols": lambda spark: symbols.resolve_symbols(symbol_inputs(spark, SF_DIR), names(spark, SF_DIR), universe(spark, SF_DIR)),
    "running_averages": averages,
}


def timed(make) -> float:
    """Seconds from the call that builds the query, with any jobs it starts, to its last row."""
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = local_session()
    wanted = sys.argv[1:] or [*OTHERS, *QUERIES]
    seconds = {}
    path = scratch_dir(spark) + "/bars"
    write_parquet(lineitem_bars(spark, SF_DIR), path)
    jobs = {name: lambda make=make: make(spark) for name, make in OTHERS.items()}
    jobs |= {name: lambda make=make: make(spark.read.parquet(path)) for name, make in QUERIES.items()}
    for name in wanted:
        # the first run compiles the generated code, the second is timed
        timed(jobs[name])
        seconds[name] = timed(jobs[name])
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
