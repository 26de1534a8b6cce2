from __future__ import annotations

import json
import zipfile

from palimspark.plans.ingest import ingest_files

WORDS = "第一条 为了规范本法所称的各种行为，保护公民、法人和其他组织的合法权益，制定本法。"


def docx(path, paragraphs):
    path.parent.mkdir(parents=True, exist_ok=True)
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')


def test_from_lines_and_docx_to_corpus_counts_and_rejects(spark, tmp_path):
    record = lambda i, title, file, status=3, category="law": json.dumps({"bbbs": i, "title": title, "category": category, "status_code": status, "effective_date": "2020-01-01", "downloaded_file": file})
    lines = [
        record("0001", "甲法", "a.docx"), record("0002", "甲法", "dir/b.doc", 2), "{broken", record("0003", "乙法", "gone.docx"), record("0004", "丙法", "c.docx"),
        record("0005", "丁法", "a.docx", 9), record("0006", "戊 法", "a.docx", None, "rule"), record("0007", "己法", "a.docx"), record("0007", "己法", "a.docx"),
    ]
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "law.jsonl").write_text("\n".join(lines), encoding="utf-8")
    docx(tmp_path / "docs/law/files/a.docx", ["甲法", "第一章 总则", WORDS, WORDS])
    docx(tmp_path / "docs/law/converted/b.docx", ["甲法", WORDS, WORDS])
    docx(tmp_path / "docs/law/files/c.docx", ["short"])
    docx(tmp_path / "docs/rule/files/a.docx", [WORDS, WORDS])
    got = ingest_files(spark, str(tmp_path / "meta"), str(tmp_path / "docs"), 40)
    rows = {r["bbbs"]: r for r in got.corpus.collect()}
    assert set(rows) == {"0001", "0002", "0006"} and rows["0006"]["slug"] == "戊法_0006" and rows["0006"]["status"] == "unlabelled"
    assert rows["0001"]["text"].startswith("## 第一章 总则") and "title: 甲法\n" in rows["0001"]["front_matter"] and "bbbs: 0001" in rows["0001"]["front_matter"]
    counts = {r["category"]: r for r in got.counts.collect()}
    assert (counts["law"]["records"], counts["law"]["missing"], counts["law"]["short"], counts["law"]["kept"], counts["law"]["multi_version"]) == (4, 1, 1, 2, 1)
    assert (counts["total"]["records"], counts["total"]["kept"], counts["total"]["titles"]) == (5, 3, 4)
    rejected = {(r["kind"], r["key"].rpartition("/")[2], r["reason"]) for r in got.rejected.collect()}
    assert rejected == {("line", "law.jsonl:3", "bad_json"), ("record", "0005", "unknown_status"), ("record", "0007", "listed_twice"), ("record", "0003", "missing_or_short"), ("record", "0004", "missing_or_short")}
