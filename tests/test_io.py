import json

import pytest

from tomeworks import cli, session
from tomeworks.functions import codec
from tomeworks.operators import index
from tomeworks.plans import core_queries
from tomeworks.sources import readers, sinks
from tomeworks.streaming import incremental

TEXTS = {
    "1": "An English grammar of Gutenberg.\r\nDornröschen and the wood.",
    "2": "Philip K Dick wrote; to be, or not to be, that is it.",
    "3": "Jabberwocky " * 3
}
CSV = 'gutenberg_id,title,author,gutenberg_author_id,language,gutenberg_bookshelf,rights,has_text\n1,Tide Almanac,"Ash, Tom",9,en,Science,,1\n1,Tide Almanac,"Roe, Ada",8,en,Science,,1\n2,Far Androids,"Dick, Philip K.",7,en,,,1\n4,Gone,,,,fr,,0\n'


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "texts").mkdir()
    for k, t in TEXTS.items():
        (tmp_path / "texts" / f"{k}.txt").write_bytes(t.encode() + (b"\xff" if k == "3" else b""))
    (tmp_path / "catalogue.csv").write_text(CSV, encoding="utf-8")
    return tmp_path


def test_texts(spark, folder):
    got = {r["gutenberg_id"]: r["text"] for r in readers.text_files(spark, str(folder / "texts")).collect()}
    assert "\r" not in got["1"] and got["3"].endswith("�") and set(got) == {"1", "2", "3"}
    assert readers.file_ids(spark, str(folder / "texts")).count() == 3


def test_catalogue(spark, folder):
    rows = readers.catalogue_csv(spark, str(folder / "catalogue.csv")).collect()
    assert rows[0].asDict() == {
        "gutenberg_id": "1", "title": "Tide Almanac", "authors": "Ash, Tom", "language": "en", "bookshelf": "Science", "rights": None
    }


def test_lists(spark, tmp_path):
    (tmp_path / "2_bm25.tsv").write_text('1\t7\t2.5\ta "b\t3\n2\tx\n3\t9\t1.0\t\t\n')
    (tmp_path / "odd.tsv").write_text("1\t7\t2.5\t\t\n")
    lines = readers.list_lines(spark, str(tmp_path))
    got = {(r["query_nr"], r["model"], r["rank"], r["gutenberg_id"], r["snippet"]) for r in readers.ranked_lists(lines).collect()}
    assert got == {("2", "bm25", 1, "7", 'a "b'), ("2", "bm25", 3, "9", ""), ("odd", "unknown", 1, "7", "")}
    assert readers.ranked_lists(lines, 2).where("query_nr = '2'").count() == 1


def test_logs_and_judgments(spark, tmp_path):
    log = str(tmp_path / "l" / "q.jsonl")
    sinks.append_log(spark, log, [{"query": "ö", "model": "bm25", "elapsed_ms": 1.25}])
    (tmp_path / "l" / "q.jsonl" / "part-typed.json").write_text("\n")
    sinks.append_log(spark, log, [{"query": "b"}])
    got = sinks.latency_rows(readers.query_log(spark, log)).orderBy("query").collect()
    assert [(r["query"], r["elapsed_ms"], r["topk"], r["phrase_fallback"]) for r in got] == [("b", "0.00", 0, False), ("ö", "1.25", 0, False)]
    path = str(tmp_path / "j.csv")
    sinks.append_judgments(spark, path, [("1", "bm25", 1, "7", 2)])
    sinks.append_judgments(spark, path, [("1", "bm25", 2, "8", 0), ("1", "bm25", 3, "8", 5)])
    assert [(r["rank"], r["label"]) for r in readers.judgments_csv(spark, path).orderBy("rank").collect()] == [(1, 2), (2, 0)]


def test_performance_table(spark, tmp_path):
    values = {
        "N": 812,
        "total_text_bytes_read": 31_400_000,
        "elapsed_seconds": 12.345,
        "docs_per_second": 65.775,
        "final_vocab_size": 90210,
        "avgdl": 377.04,
        "postings_bytes": 1_250_000
    }
    sinks.write_report(spark, str(tmp_path / "b.json"), values)
    rows = {r["metric"]: (r["value"], r["unit"]) for r in sinks.performance_rows(readers.build_metrics(spark, str(tmp_path / "b.json"))).collect()}
    assert rows == {
        "N": ("812", ""), "total_text_bytes_read": ("31.40", "MB"), "elapsed_seconds": ("12.35", "s"), "docs_per_second": ("65.78", "per s"),
        "final_vocab_size": ("90210", ""), "avgdl": ("377.04", ""), "postings_bytes": ("1.25", "MB"),
    }


def test_table_for_print():
    t = sinks.latex_table(["q", "x_y"], [["1", "a&b"], ["1", "5% {of} \\ $3 ~ ^"], ["2", "ö#"], ["2", None]], "c", "t:x", group_by=0)
    assert r"a\&b" in t and r'{\"o}\#' in t and r"x\_y" in t and r"5\% \{of\} \textbackslash{} \$3 \textasciitilde{} \textasciicircum{}" in t
    assert t.count(r"\midrule") == 2 and sinks.latex_escape("Čapek, façade, Å") == r"{\v C}apek, fa{\c c}ade, {\r A}"


def test_byte_lists(tmp_path):
    lists = [("b", [(7, 1), (3, 2)]), ("a", []), ("c", [(0, 300), (100_000, 1)])]
    rows = codec.write_postings(str(tmp_path / "p"), lists)
    assert [(t, n) for t, n, _, _ in rows] == [("b", 2), ("a", 0), ("c", 2)]
    with codec.PostingsFile(str(tmp_path / "p")) as f:
        assert [f.read(at, size) for _, _, at, size in rows] == [[(3, 2), (7, 1)], [], [(0, 300), (100_000, 1)]]
        assert f.read(*rows[0][2:]) is f.read(*rows[0][2:])
        with pytest.raises(OSError):
            f.read(rows[2][2], rows[2][3] + 1)
    f.close()
    with pytest.raises(FileNotFoundError):
        codec.PostingsFile(str(tmp_path / "none")).read(0, 1)


def test_byte_lists_of_hot_terms_are_split_by_ranges(spark):
    rows = [("hot", d, 1 + d % 3) for d in range(0, 300_000, 7)] + [("cold", 5, 2), ("cold", 200_000, 1)]
    df = spark.createDataFrame(rows, "term string, docid long, tf int")
    lists = codec.encode_lists(df)
    parts = {(r["term"], r["part"]): r["df"] for r in lists.select("term", "part", "df").collect()}
    assert parts.keys() == {("hot", k) for k in range(5)} | {("cold", 0), ("cold", 3)} and max(parts.values()) <= codec.SPREAD
    assert sorted(map(tuple, codec.decode_lists(lists).collect())) == sorted(rows)
    assert codec.decode_lists(codec.encode_lists(df.limit(0))).count() == 0


def test_commands(spark, folder, capsys, monkeypatch):
    run = lambda *a: cli.main(["--data", str(folder), *a])
    assert run("validate_dataset") == 0
    assert json.loads((folder / "reports/dataset_report.json").read_text()) == {"raw_rows": 4, "unique_ids": 3, "with_text": 2, "missing_text": 1}
    assert run("index", "--k1", "1.5") == 0 and run("validate_index") == 0
    assert index.load(spark, str(folder / "index_full")).k1 == 1.5
    capsys.readouterr()
    assert run("search", "--model", "structured", "--query", "Philip K Dick") == 0
    assert "8.0000" in capsys.readouterr().out
    assert run("run_eval_queries", "--allow-full-scan") == 0
    files = sorted(p.name for p in (folder / "tsv_full").glob("*.tsv"))
    assert len(files) == 18 and (folder / "tsv_full/4_bm25.tsv").read_text().startswith("1\t3\t")
    first = {p.name: p.read_bytes() for p in (folder / "tsv_full").glob("*.tsv")}
    run("run_eval_queries", "--allow-full-scan")
    assert first == {p.name: p.read_bytes() for p in (folder / "tsv_full").glob("*.tsv")}
    assert run("validate_tsv") == 0
    (folder / "tsv_full/1_vsm.tsv").unlink()
    assert run("validate_tsv") == 1
    answers = iter(["9", "1"])
    args = cli.parser().parse_args(["--data", str(folder), "judge", "--tsv", str(folder / "tsv_full/4_bm25.tsv")])
    assert cli.judge(cli.Workspace(spark, str(folder), False), args, lambda _: next(answers)) == 0
    assert [tuple(r) for r in readers.judgments_csv(spark, str(folder / "judgments/judgments.csv")).collect()] == [("4", "bm25", 1, "3", 1)]
    assert run("run_eval_queries", "--allow-full-scan") == 0 and run("check_determinism", "--allow-full-scan") == 0
    log = readers.query_log(spark, str(folder / "logs/query_metrics.jsonl"))
    told = {(r["model"], r["query"]): r for r in log.where("topk = 100").collect()}
    assert len(told) == 18 and told["bm25", "Jabberwocky"]["postings_accessed"] == 1 and told["bm25", "Jabberwocky"]["candidates_scored"] == 1
    for name in cli.REPORTS:
        assert run(name) == 0
    made = {p.name: p.read_text() for p in (folder / "analysis").iterdir() if p.suffix in (".csv", ".json", ".tex")}
    assert len(made) == 12 and all(made.values())
    assert made["metrics_by_query_model.csv"].splitlines() == [
        "query_nr,query_text,model,P@10,P@10_partial,AP@10,NDCG@10,result_count", "4,Jabberwocky,bm25,0.1000,0.1000,1.0000,1.0000,1"
    ]
    assert made["metrics_summary.csv"].splitlines()[1] == "bm25,0.1000,0.1000,1.0000,1.0000,1"
    overlap = made["top10_overlap.csv"].splitlines()
    assert len(overlap) == 19 and overlap[0] == "query_nr,pair,overlap_top10,jaccard_top10" and "4,vsm_vs_bm25,1,1.0000" in overlap
    assert len(made["score_stats_by_query_model.csv"].splitlines()) == 19 and "4,structured,0,,,,," in made["score_stats_by_query_model.csv"]
    assert json.loads(made["tsv_comparison.json"])["4"]["models"]["bm25"] == {"result_count": 1, "top10_ids": ["3"]}
    assert "postings_bytes" in made["performance_table.csv"] and len(made["query_latency_table.csv"].splitlines()) > 18
    lines = iter(["bm25 grammar", "nonsense", ""])
    assert cli.interactive(cli.Workspace(spark, str(folder), False), args=cli.parser().parse_args(["interactive"]), ask=lambda _: next(lines)) == 0


def test_stream_gives_the_same_index(spark, tmp_path):
    docs = [("1", "apple banana café"), ("2", "apple"), ("3", None)]
    schema = "gutenberg_id string, text string"
    whole = index.build(spark.createDataFrame(docs, schema))
    for part in (docs[:1], docs[1:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = incremental.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    streamed = incremental.finish(spark, str(tmp_path / "out"))
    assert (streamed.n, streamed.avgdl) == (whole.n, whole.avgdl)
    for name in ("postings", "lexicon", "docstats"):
        a, b = getattr(streamed, name), getattr(whole, name)
        assert a.select(*b.columns).exceptAll(b).count() == b.exceptAll(a.select(*b.columns)).count() == 0


def test_intermediate_tables_need_a_shared_folder_off_one_process(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    monkeypatch.setattr(session, "ship", lambda spark: None)
    with pytest.raises(ValueError, match="shared|share"):
        session.shared_dir(Session())


def test_rewritten_tables_are_read_anew(spark, tmp_path):
    def write(texts):
        docs = [(i, t, "7", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(docs, "doc_id long, text string, gutenberg_id string, n_chars long").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))

    write(["one two", "three"])
    first = core_queries.doc_len(spark, str(tmp_path)).collect()
    assert core_queries.corpus_index(spark, str(tmp_path)) is core_queries.corpus_index(spark, str(tmp_path))
    write(["one two", "three", "four"])
    assert (first[0]["doc_len"], core_queries.doc_len(spark, str(tmp_path)).first()["doc_len"]) == (3, 4)
