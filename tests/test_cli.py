import json

from lakeloom import cli


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda *_: spark)
    docs = [{"link": "https://x.example/a", "title": "SU", "sections": [{"heading": "Stipendium", "content": "Du kan få stipendium, hvis du er i gang."}]}]
    for day, text in (("2025-01-01", "Du kan få stipendium."), ("2025-02-01", "Du kan få mere stipendium.")):
        docs[0]["sections"][0]["content"] = text
        (tmp_path / f"links_content_{day}.json").write_text(json.dumps(docs))
        (tmp_path / f"{day}.txt").write_text(f"/a\n/{day}\n")
    assert cli.main(["hqe-generate", str(tmp_path / "links_content_2025-01-01.json"), str(tmp_path / "hqe")]) == 0
    rows = spark.read.json(str(tmp_path / "hqe")).collect()
    assert {r.section_index for r in rows} == {-1, 0} and all(r.questions for r in rows)
    assert cli.main(["embed-hqe", str(tmp_path / "hqe"), str(tmp_path / "vec")]) == 0
    assert spark.read.parquet(str(tmp_path / "vec")).filter("size(embedding) = 64").count() > 0
    assert cli.main(["changes-content", str(tmp_path)]) == 0
    assert cli.main(["changes-links", str(tmp_path / "2025-01-01.txt"), str(tmp_path / "2025-02-01.txt")]) == 0
    out = capsys.readouterr().out
    assert "changed" in out and "added /2025-02-01" in out and "removed /2025-01-01" in out
    assert cli.main(["changes-content", str(tmp_path / "missing")]) == 1


def test_scrape_and_ask(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda *_: spark)
    site = tmp_path / "site"
    site.mkdir()
    (site / "index.html").write_text("<title>Forside</title><a href='/a'>a</a><a href='/x.pdf'>p</a><article><p>Velkommen til siden om stipendium.</p></article>")
    (site / "a.html").write_text("<title>Om &amp; SU</title><a href=/b>b</a><article><h1>Stipendium</h1><p>Du kan få stipendium, når du er i gang.</p></article>")
    assert cli.main(["scrape-content", str(site), str(tmp_path / "corpus.json"), "--base", "https://x.example/?"]) == 0
    docs = {r.title: r for r in spark.read.json(str(tmp_path / "corpus.json")).collect()}
    assert set(docs) == {"Forside", "Om & SU"} and docs["Om & SU"].sections[0].heading == "Stipendium" and docs["Forside"].doc_id
    (tmp_path / "seen").write_text("/old\n")
    assert cli.main(["scrape-links", str(site), str(tmp_path / "links"), "--seen", str(tmp_path / "seen")]) == 0
    assert {r.value for r in spark.read.text(str(tmp_path / "links")).collect()} >= {"/old"}
    (tmp_path / "corpus1.json").write_text(json.dumps([{"link": "https://x.example/a", "title": "SU", "sections": [{"heading": "Stipendium", "content": "Du kan få stipendium, hvis du er i gang."}]}]))
    assert cli.main(["hqe-generate", str(tmp_path / "corpus1.json"), str(tmp_path / "hqe")]) == 0
    assert cli.main(["embed-hqe", str(tmp_path / "hqe"), str(tmp_path / "vec")]) == 0
    question = spark.read.parquet(str(tmp_path / "vec")).filter("section_index = 0").first().question
    (tmp_path / "ask.txt").write_text(f"{question}\n\n")
    assert cli.main(["qa-console", str(tmp_path / "vec"), str(tmp_path / "corpus1.json"), str(tmp_path / "ask.txt"), "--k", "2"]) == 0
    out = capsys.readouterr().out
    assert f"> {question}" in out and "1. SU - Stipendium (1.0000) https://x.example/a" in out
