"""Command line: catalogue validation, index build and checks, search, batch evaluation, judging, reports."""

from __future__ import annotations

import argparse
import resource
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeworks import reports
from tomeworks.functions import scoring
from tomeworks.operators import evalkit, index, metadata, phrase, rank, snippet
from tomeworks.session import CHECKPOINT_CONF, bytes_in, files_in, materialize, write_text
from tomeworks.sources import readers, sinks

# The evaluated queries.
QUERIES = {1: "to be, or not to be", 2: "English Grammar", 3: "Philip K Dick", 4: "Jabberwocky", 5: "Gutenberg", 6: "Dornröschen"}
MODELS = ("structured", "vsm", "bm25")
TOP = 100


def session(data: str) -> SparkSession:
    """A session whose intermediate tables lie beside the data, where all executors reach them, unless the cluster names a folder."""
    spark = SparkSession.builder.appName("tomeworks").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if not (spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)):
        spark.conf.set(CHECKPOINT_CONF, f"{data.rstrip('/')}/.work")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tomeworks", description="Full-text retrieval on Spark")
    p.add_argument("--data", default="data", help="folder with catalogue.csv, texts/, and what the commands write")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, **options: dict) -> None:
        c = sub.add_parser(name)
        c.add_argument("--sample", action="store_true", help="work on the sample texts and their index")
        for o, kw in options.items():
            c.add_argument("--" + o.replace("_", "-"), **kw)

    scan = {"action": "store_true", "help": "let the phrase fallback read all texts"}
    add("validate_dataset")
    add("index", k1={"type": float, "default": scoring.K1}, b={"type": float, "default": scoring.B})
    add("validate_index")
    add("search", model={"choices": MODELS, "required": True}, query={"required": True}, topk={"type": int, "default": 10}, allow_full_scan=scan)
    add("interactive", allow_full_scan=scan)
    add("run_eval_queries", allow_full_scan=scan)
    add("validate_tsv")
    add("check_determinism", allow_full_scan=scan)
    add("judge", tsv={"required": True}, k={"type": int, "default": 10})
    for name in REPORTS:
        add(name)
    return p


class Workspace:
    """The folders of one data set."""

    def __init__(self, spark: SparkSession, root: str, sample: bool):
        self.spark, self.root = spark, root.rstrip("/")
        kind = "sample" if sample else "full"
        self.texts, self.index_path = f"{self.root}/{'sample' if sample else 'texts'}", f"{self.root}/index_{kind}"
        self.lists, self.reports, self.analysis = f"{self.root}/tsv_{kind}", f"{self.root}/reports", f"{self.root}/analysis"
        self.log, self.judgments = f"{self.root}/logs/query_metrics.jsonl", f"{self.root}/judgments/judgments.csv"

    def catalogue(self) -> DataFrame:
        merged = metadata.merge(readers.catalogue_csv(self.spark, f"{self.root}/catalogue.csv"))
        return metadata.flag_text(merged, readers.file_ids(self.spark, self.texts))

    def docs(self) -> DataFrame:
        return readers.text_files(self.spark, self.texts)

    def index(self) -> index.Index:
        return index.load(self.spark, self.index_path)

    def metadata(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.index_path}/metadata")

    def titles(self) -> DataFrame | None:
        return self.metadata() if bytes_in(self.spark, f"{self.index_path}/metadata") else None

    def queries(self) -> DataFrame:
        return rank.query_frame(self.spark, QUERIES)

    def list_files(self) -> dict[str, int]:
        return {n: size for n, size in files_in(self.spark, self.lists).items() if n.endswith(".tsv")}

    def lines(self) -> DataFrame:
        """The lines of all lists that have any."""
        filled = [f"{self.lists}/{n}" for n, size in self.list_files().items() if size]
        if not filled:
            return self.spark.createDataFrame([], "query_nr string, model string, line int, value string")
        return readers.list_lines(self.spark, filled)

    def ranked(self) -> DataFrame:
        return readers.ranked_lists(self.lines())

    def search(self, model: str, queries: dict[int, str], allow_full_scan: bool, k: int) -> tuple[DataFrame, list[dict[str, object]]]:
        """The first k results of each query (query_nr, rank, gutenberg_id, score), and what the log tells of each query."""
        began = time.time()
        q = rank.asked(rank.query_frame(self.spark, queries))
        if model == "structured":
            found, read = rank.structured(rank.searchable(self.metadata()), q), None
        else:
            built = self.index()
            read = rank.terms_in_lexicon(built, q)
            if model == "vsm":
                found = rank.cosine(built, q)
                read = read.join(rank.triggered(built, q).where("not fallback").select("query_nr"), "query_nr", "left_semi")
            else:
                found = phrase.bm25_with_fallback(built, self.docs(), q, allow_full_scan)
        if "fallback_used" not in found.columns:
            found = found.withColumn("fallback_used", F.lit(False))
        found = materialize(found, "found")
        top = materialize(rank.rank(found, k), "found-top")
        counts = {r["query_nr"]: r for r in found.groupBy("query_nr").agg(F.count("*").alias("n"), F.max("fallback_used").alias("f")).collect()}
        read = {r["query_nr"]: r["n"] for r in read.groupBy("query_nr").agg(F.sum("df").alias("n")).collect()} if read is not None else {}
        each = (time.time() - began) * 1000 / max(1, len(queries))  # a batch is one job: every query has its share of it
        entries = [
            {
                "model": model, "query": text, "topk": k, "elapsed_ms": round(each, 2), "postings_accessed": read.get(n, 0),
                "candidates_scored": counts[n]["n"] if n in counts else 0, "phrase_fallback_used": bool(n in counts and counts[n]["f"]),
            }
            for n, text in queries.items()
        ]
        return top, entries

    def evaluate(self, allow_full_scan: bool, folder: str) -> None:
        """All lists of the evaluated queries, written to folder, and a line in the log for each."""
        found, entries = None, []
        for m in MODELS:
            one, told = self.search(m, QUERIES, allow_full_scan, TOP)
            one = one.withColumn("model", F.lit(m))
            found = one if found is None else found.unionByName(one)
            entries += told
        results = snippet.snippets(self.index(), self.docs(), rank.asked(self.queries()), found, self.metadata())
        sinks.write_list_files(results, folder, [(n, m) for n in QUERIES for m in MODELS], TOP)
        sinks.append_log(self.spark, self.log, entries)


def validate_dataset(w: Workspace, _: argparse.Namespace) -> int:
    raw = readers.catalogue_csv(w.spark, f"{w.root}/catalogue.csv")
    sinks.write_catalogue(w.catalogue(), f"{w.index_path}/metadata")
    flagged = w.metadata()
    report = metadata.report(raw, flagged).first().asDict()
    sinks.write_report(w.spark, f"{w.reports}/dataset_report.json", report)
    sinks.write_missing(metadata.missing(flagged), f"{w.reports}/missing_text_ids")
    print(report)
    return 0


def build_index(w: Workspace, args: argparse.Namespace) -> int:
    began = time.time()
    sinks.write_catalogue(w.catalogue(), f"{w.index_path}/metadata")
    built = index.build(w.docs(), args.k1, args.b)
    index.save(built, w.index_path)
    seconds = time.time() - began
    read = sum(size for name, size in files_in(w.spark, w.texts).items() if name.endswith(".txt"))
    report = {
        "N": built.n, "total_text_bytes_read": read, "elapsed_seconds": seconds, "docs_per_second": built.n / seconds if seconds else 0.0,
        "mb_per_second": read / 1e6 / seconds if seconds else 0.0, "peak_tracemalloc_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024,
        "blocks_written": sum(n.endswith(".parquet") for n in files_in(w.spark, f"{w.index_path}/postings")), "final_vocab_size": built.lexicon.count(),
        "avgdl": built.avgdl, "postings_bytes": bytes_in(w.spark, f"{w.index_path}/postings"),
        "sqlite_bytes": sum(bytes_in(w.spark, f"{w.index_path}/{t}") for t in ("lexicon", "docstats", "globals", "metadata")),
    }
    sinks.write_report(w.spark, f"{w.reports}/index_build_metrics.json", report)
    print(report)
    return 0


def validate_index(w: Workspace, _: argparse.Namespace) -> int:
    bad = index.validate(w.index())
    n = bad.count()
    bad.show(20, truncate=False)
    print("valid" if not n else f"{n} failures")
    return int(n > 0)


def one_search(w: Workspace, model: str, query: str, k: int, allow_full_scan: bool) -> list:
    found, entries = w.search(model, {1: query}, allow_full_scan, k)
    rows = readers.titles(found, w.titles()).orderBy("rank").collect()
    sinks.append_log(w.spark, w.log, entries)
    for r in rows:
        print(f"{r['rank']:>3}  {r['gutenberg_id']:>8}  {r['score']:.4f}  {r['title']} | {r['authors']}")
    return rows


def search(w: Workspace, args: argparse.Namespace) -> int:
    one_search(w, args.model, args.query, args.topk, args.allow_full_scan)
    return 0


def interactive(w: Workspace, args: argparse.Namespace, ask: Callable[[str], str] = input) -> int:
    """Lines of "model query"; an empty line ends."""
    while line := ask("model query> ").strip():
        model, _, query = line.partition(" ")
        if model in MODELS and query:
            one_search(w, model, query, 10, args.allow_full_scan)
        else:
            print(f"one of {', '.join(MODELS)}, then the query")
    return 0


def run_eval_queries(w: Workspace, args: argparse.Namespace) -> int:
    w.evaluate(args.allow_full_scan, w.lists)
    return 0


def validate_tsv(w: Workspace, _: argparse.Namespace) -> int:
    """Faults of the lists. A list without results has an empty file; only one without a file is missing."""
    there = w.list_files()
    absent = [(str(n), m, 0, "missing") for n in QUERIES for m in MODELS if f"{n}_{m}.tsv" not in there]
    bad = [tuple(r) for r in evalkit.validate_lists(w.lines()).collect()]
    for r in bad + absent:
        print(*r)
    return int(bool(bad or absent))


def check_determinism(w: Workspace, args: argparse.Namespace) -> int:
    """A second run of all queries, held against the lists of the first line by line."""
    first, there = materialize(w.lines(), "first-run"), set(w.list_files())
    again = Workspace(w.spark, w.root, False)
    again.index_path, again.texts, again.lists = w.index_path, w.texts, f"{w.lists}_again"
    w.evaluate(args.allow_full_scan, again.lists)
    missing = sorted({f"{n}_{m}.tsv" for n in QUERIES for m in MODELS} - (there & set(again.list_files())))
    off = evalkit.differences(first, again.lines()).select("query_nr", "model").distinct().orderBy("query_nr", "model").collect()
    for name in missing:
        print("missing", name)
    for r in off:
        print("differs", r["query_nr"], r["model"])
    return int(bool(missing or off))


def judge(w: Workspace, args: argparse.Namespace, ask: Callable[[str], str] = input) -> int:
    rows = readers.ranked_lists(readers.list_lines(w.spark, args.tsv), args.k).orderBy("rank").collect()
    judged = []
    for r in rows:
        print(r["rank"], r["gutenberg_id"], (r["snippet"] or "")[:80])
        while (label := ask("label (1 relevant, 2 partly, 0 not): ").strip()) not in ("0", "1", "2"):
            print("0, 1 or 2")
        judged.append((r["query_nr"], r["model"], r["rank"], r["gutenberg_id"], int(label)))
    if not judged:
        print("nothing to judge")
        return 0
    schema = "query_nr string, model string, rank int, gutenberg_id string, label int"
    one = evalkit.judged_precision(w.spark.createDataFrame(judged, schema)).first()
    print(f"precision {one['p']:.2f}, with partly relevant as half {one['p_partial']:.2f}")
    sinks.append_judgments(w.spark, w.judgments, judged)
    return 0


def compute_metrics(w: Workspace, _: argparse.Namespace) -> int:
    judged = materialize(readers.judgments_csv(w.spark, w.judgments), "judgments")
    table = materialize(reports.metrics_by_list(judged, w.queries()).coalesce(1), "metrics")
    for name in ("metrics_by_query_model", "report_results_table"):
        rows = sinks.write_table(table, f"{w.analysis}/{name}.csv")
    means = sinks.write_table(reports.metrics_by_model(judged, MODELS), f"{w.analysis}/metrics_summary.csv")
    for r in means:
        print(*r)
    tex = sinks.latex_table(table.columns, rows, "Measures of each query and model", "tab:measures", group_by=0)
    write_text(w.spark, f"{w.analysis}/latex_metrics_table.tex", tex)
    return 0


def compare_models(w: Workspace, _: argparse.Namespace) -> int:
    ranked = materialize(w.ranked(), "ranked")
    sinks.write_table(reports.comparison(ranked, w.queries()), f"{w.analysis}/tsv_comparison_table.csv")
    found = reports.first_ids(ranked)
    none = {"result_count": 0, f"top{evalkit.K}_ids": []}
    whole = {str(n): {"query_text": t, "models": {m: found.get(str(n), {}).get(m, none) for m in MODELS}} for n, t in QUERIES.items()}
    sinks.write_report(w.spark, f"{w.analysis}/tsv_comparison.json", whole)
    return 0


def topk_overlap(w: Workspace, _: argparse.Namespace) -> int:
    table = reports.pair_overlap(w.ranked(), w.queries())
    rows = sinks.write_table(table, f"{w.analysis}/top10_overlap.csv")
    write_text(
        w.spark,
        f"{w.analysis}/latex_overlap_table.tex",
        sinks.latex_table(table.columns, rows, "Results shared by two models", "tab:shared", group_by=0)
    )
    return 0


def score_distribution(w: Workspace, _: argparse.Namespace) -> int:
    sinks.write_table(reports.score_spread(w.ranked(), w.queries(), MODELS), f"{w.analysis}/score_stats_by_query_model.csv")
    return 0


def parse_performance_logs(w: Workspace, _: argparse.Namespace) -> int:
    table = sinks.performance_rows(readers.build_metrics(w.spark, f"{w.reports}/index_build_metrics.json"))
    rows = sinks.write_table(table, f"{w.analysis}/performance_table.csv")
    write_text(w.spark, f"{w.analysis}/latex_perf_table.tex", sinks.latex_table(table.columns, rows, "The build of the index", "tab:build"))
    log = readers.query_log(w.spark, w.log).orderBy("timestamp", "model", "query")
    sinks.write_table(sinks.latency_rows(log), f"{w.analysis}/query_latency_table.csv")
    return 0


def emit_latex_tables(w: Workspace, args: argparse.Namespace) -> int:
    """The tables for print of measures and overlap, which their commands write beside the CSV files."""
    return compute_metrics(w, args) or topk_overlap(w, args)


REPORTS = {
    "compute_metrics": compute_metrics, "compare_models": compare_models, "topk_overlap": topk_overlap, "score_distribution": score_distribution,
    "parse_performance_logs": parse_performance_logs, "emit_latex_tables": emit_latex_tables,
}
COMMANDS = REPORTS | {
    "validate_dataset": validate_dataset, "index": build_index, "validate_index": validate_index, "search": search, "interactive": interactive,
    "run_eval_queries": run_eval_queries, "validate_tsv": validate_tsv, "check_determinism": check_determinism, "judge": judge,
}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return COMMANDS[args.command](Workspace(session(args.data), args.data, args.sample), args)
