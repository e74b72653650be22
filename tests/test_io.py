"""Readers, writers, flows, command line and streams."""

import json
import os
import zipfile

import pytest

from textloom import cli
from textloom.operators import scoring
from textloom.operators.prepare import PrepareOptions
from textloom.plans import pipelines
from textloom.sources import readers, writers
from textloom.streaming import windows as streams


def docx(path, paragraphs):
    w = readers.WORDS[1:-1]
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')


def test_read_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"one\r\ntwo\rthree\xff")
    docx(tmp_path / "b.docx", [" first ", "", "second"])
    rows = {os.path.basename(r["path"]): r["text"] for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert rows == {"a.TXT": "one\ntwo\nthree�", "b.docx": "first\n\nsecond"}


def test_pdf_on_a_stub(monkeypatch):
    """Texts of all pages, also of empty ones, parted by empty lines."""
    import sys
    import types

    library = types.ModuleType("pypdf")
    page = lambda t: types.SimpleNamespace(extract_text=lambda: t)
    library.PdfReader = lambda f: types.SimpleNamespace(pages=[page(x) for x in (f.read().decode(), " two ", None)])
    monkeypatch.setitem(sys.modules, "pypdf", library)
    assert readers.FORMATS[".pdf"](b" one\n") == "one\n\ntwo\n\n"
    monkeypatch.setitem(sys.modules, "pypdf", None)
    with pytest.raises(RuntimeError, match="pypdf"):
        readers.text_of_pdf(b"x")


def test_unknown_suffix_raises(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x")
    with pytest.raises(Exception, match="Unsupported file type"):
        readers.read_files(spark, str(tmp_path)).collect()


def test_missing_path_raises(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        readers.read_files(spark, "/no/such/file.txt").collect()


def test_jsonl_keeps_odd_line_breaks(spark, tmp_path):
    rows = [("a b\u0085c", "1"), ("", None)]
    writers.write_jsonl(spark.createDataFrame(rows, "text string, label string"), str(tmp_path / "x"))
    back = readers.read_jsonl(spark, str(tmp_path / "x"), "text string, label string").collect()
    assert sorted(map(tuple, back), key=str) == sorted(rows, key=str)


def test_malformed_line_raises(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "a"}\n{oops\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "text string").collect()


def test_document_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (0, "a")], "seq long, label string")
    writers.write_documents(df, str(tmp_path / "two.json"))
    writers.write_documents(df.filter("seq = 0"), str(tmp_path / "one.json"))
    writers.write_documents(df.filter("seq > 5"), str(tmp_path / "none.json"))
    assert not writers.write_documents(df.filter("seq > 5"), str(tmp_path / "skip.json"), skip_empty=True)
    read = lambda n: json.loads((tmp_path / n).read_text())
    assert read("two.json") == {"docs": [{"label": "a"}, {"label": "b"}]}
    assert read("one.json") == {"label": "a"} and read("none.json") == {"docs": []} and not (tmp_path / "skip.json").exists()


def test_many_documents_are_one_object(spark, tmp_path):
    writers.write_documents(spark.range(1500).selectExpr("-id as seq", "id as label"), str(tmp_path / "many.json"))
    assert json.loads((tmp_path / "many.json").read_text()) == {"docs": [{"label": i} for i in range(1499, -1, -1)]}


def test_files_of_other_tools_keep_labels_and_metadata(spark, tmp_path):
    """Flat metadata, numeric labels, ids that are null or missing: as they come in, so they go out."""
    words = " ".join(f"word{i}" for i in range(120)) + "."
    meta = {"source": "web", "page": 3, "tags": ["a"], "text_id": "t1", "estimated_tokens": 9}
    lines = [{"text": words, "label": 1, "meta": {**meta, "window_index": i, "window_text_id": f"w{i}", "window_estimated_tokens": 5}} for i in (1, 0)]
    lines += [{"text": words, "label": "ai", "meta": {"text_id": None}}, {"text": words, "label": None, "meta": {}}]
    (tmp_path / "x_prepared.jsonl").write_text("\n".join(map(json.dumps, lines)))
    made = pipelines.score(spark, str(tmp_path / "x_prepared.jsonl"), pipelines.ScoreOptions(aggregate_doc=True, with_heuristics=True))
    rows = [json.loads(x) for f in sorted(os.listdir(made[0])) if f.endswith(".json") for x in open(f"{made[0]}/{f}")]
    assert [r["label"] for r in rows] == [1, 1, "ai", None] and rows[0]["meta"] == lines[0]["meta"]
    assert set(rows[0]) == {"label", "meta", "features", "heuristics_score"}
    docs = {d["meta"]["text_id"]: d for d in json.loads(open(made[1]).read())["docs"]}
    assert set(docs) == {"t1", "None"} and docs["t1"]["meta"] == {**meta, "level": "doc"} and docs["t1"]["label"] == 1


def test_output_names():
    assert writers.output_names("/d/x_prepared.jsonl", None, "logits") == ("/d/x_logits_windows.jsonl", "/d/x_logits_doc.json")


def test_flow_from_file_to_features(spark, tmp_path):
    text = "\n\n".join(f"Paragraph {i} says this. It says that, too." for i in range(40))
    (tmp_path / "in.txt").write_text(text)
    cli.main(["get-text", "--input_path", str(tmp_path / "in.txt"), "--output_path", str(tmp_path / "out.txt"), "--max_estimated_tokens", "128", "--prepare_examples"], spark)
    assert (tmp_path / "out.txt").read_text().count("--- WINDOW ---") > 1
    cli.main(["score", "--prepared_path", str(tmp_path / "out_prepared.jsonl"), "--with_heuristics", "--aggregate_doc"], spark)
    doc = json.loads((tmp_path / "out_heuristics_doc.json").read_text())
    assert doc["meta"]["level"] == "doc" and 0 <= doc["heuristics_score"] <= 1 and doc["label"] == 0
    pair, single, _ = scoring.byte_scorers(spark.createDataFrame([(text,)], "text string"))
    options = pipelines.ScoreOptions(aggregate_doc=True, observer=pair, performer=single, two_model=scoring.TwoModelOptions("io-pair", "io-single"), model=pair, model_id="io-pair")
    made = pipelines.score(spark, str(tmp_path / "out_prepared.jsonl"), options)
    assert len(made) == 4 and "mean_mean_logprob" in json.loads((tmp_path / "out_logits_doc.json").read_text())["logits_features"]


def test_print_comes_before_any_writing(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("a  b")
    cli.main(["get-text", "--input_path", str(tmp_path / "in.txt"), "--print"], spark)
    assert capsys.readouterr().out == "a b\n" and os.listdir(tmp_path) == ["in.txt"]


def test_stream(spark, tmp_path):
    lines = [json.dumps({"text": f"Some words here {i}. " * 60, "label": "0", "seq": i}) for i in range(3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(lines))
    rows = streams.stream_window_features(streams.stream_examples(spark, str(tmp_path / "in")), PrepareOptions(128))
    q = streams.stream_document_scores(rows).writeStream.outputMode("complete").format("memory").queryName("scores").start()
    try:
        q.processAllAvailable()
        assert spark.sql("SELECT count(*), min(windows) > 1 FROM scores").first()[:] == (3, True)
    finally:
        q.stop()
