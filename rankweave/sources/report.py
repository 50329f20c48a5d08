"""Small results as text: tables of metrics, calibration reports, search results, and one JSON object.

Everything here is for results of a few rows per scorer, which the driver collects.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def metric_table(results: DataFrame) -> str:
    """results(scorer, cutoff, queries, ndcg, map, mrr, recall) as tab-separated lines, four decimals."""
    rows = results.collect()
    cutoffs = sorted({r.cutoff for r in rows})
    names = [f"{m}@{k}" for k in cutoffs for m in ("ndcg", "map", "mrr", "recall")]
    lines = ["\t".join(["scorer", "queries", *names])]
    for scorer in sorted({r.scorer for r in rows}):
        by = {r.cutoff: r for r in rows if r.scorer == scorer}
        cells = [f"{by[k][m]:.4f}" if k in by else "0.0000" for k in cutoffs for m in ("ndcg", "map", "mrr", "recall")]
        lines.append("\t".join([scorer, str(max(r.queries for r in by.values())), *cells]))
    return "\n".join(lines) + "\n"


def calibration_table(results: DataFrame) -> str:
    """results(scorer, ece, brier, samples) as tab-separated lines, six decimals."""
    lines = ["\t".join(("scorer", "ece", "brier", "samples"))]
    lines += [f"{r.scorer}\t{r.ece:.6f}\t{r.brier:.6f}\t{r.samples}" for r in results.orderBy("scorer").collect()]
    return "\n".join(lines) + "\n"


def calibration_report(summary: DataFrame, bins: DataFrame) -> str:
    """One calibration with its reliability bins, in columns of fixed width."""
    s = summary.first()
    lines = ["Calibration", f"  samples {s.samples:>12}", f"  ECE     {s.ece:>12.6f}", f"  Brier   {s.brier:>12.6f}", f"  {'predicted':>10} {'observed':>10} {'count':>8}"]
    lines += [f"  {r.mean_p:>10.4f} {r.mean_y:>10.4f} {r.n:>8}" for r in bins.orderBy("bin").collect()]
    return "\n".join(lines) + "\n"


def search_lines(ranked: DataFrame) -> str:
    """One query's best documents: rank, id and score."""
    return "".join(f"{r['rank']}\t{r.doc_id}\t{r.score:.6f}\n" for r in ranked.orderBy("rank").collect())


def trace_lines(trace, depth: int = 0) -> str:
    """A collected trace as indented names and values."""
    out = ""
    for name, value in trace.asDict().items():
        pad = "  " * depth
        if isinstance(value, list):
            out += f"{pad}{name}:\n" + "".join(trace_lines(v, depth + 1) for v in value)
        elif hasattr(value, "asDict"):
            out += f"{pad}{name}:\n{trace_lines(value, depth + 1)}"
        else:
            out += f"{pad}{name}: {value:.6f}\n" if isinstance(value, float) else f"{pad}{name}: {value}\n"
    return out


def payload(**tables: DataFrame | dict) -> str:
    """A JSON object of collected tables and options."""
    return json.dumps({k: v if isinstance(v, dict) else [r.asDict(recursive=True) for r in v.collect()] for k, v in tables.items()}, sort_keys=True)


def read_split(path: str) -> tuple[list, list]:
    """Training and evaluation ids of a JSON file: trainQueryIds or train, and evalQueryIds or eval."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    got = [d.get(long, d.get(short)) for long, short in (("trainQueryIds", "train"), ("evalQueryIds", "eval"))]
    if not all(isinstance(x, list) for x in got):
        raise ValueError("a split needs both lists of ids")
    return got[0], got[1]
