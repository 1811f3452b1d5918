import json

from pyspark.sql import functions as F

from corpusflow.operators.matching import concept_label
from corpusflow.sources import catalogues as C
from corpusflow.sources import corpus as S
from corpusflow.sources import files as FI
from corpusflow.sources import ledger as L
from corpusflow.sources import reference as R
from corpusflow.sources.structured import CAPTION_SPEC, PART_SPEC, PLAN_SPEC, validate_json

PAYLOADS = {
    "openalex": ('{"results":[{"display_name":"T","best_oa_location":{"pdf_url":null,"landing_page_url":"https://a.org/1"},'
                 '"authorships":[{"author":{"display_name":"A B"}}]},{"display_name":"none"}]}', ("https://a.org/1", "T", ["A B"])),
    "archive.org": ('{"response":{"docs":[{"identifier":"x1","creator":"A B","title":"T"},{"creator":"no id"}]}}',
                    ("https://archive.org/details/x1", "T", ["A B"])),
    "zenodo": ('{"hits":{"hits":[{"metadata":{"title":"T","creators":[{"name":"B, A"}]},"files":[{"key":"d.csv","links":'
               '{"self":"https://z/d"}},{"key":"p.PDF","links":{"self":"https://z/p"}}]}]}}', ("https://z/p", "T", ["B, A"])),
    "doaj": ('{"results":[{"bibjson":{"title":"T","author":[{"name":"A B"}],"link":[{"type":"other","url":"https://d/1"},'
             '{"type":"fulltext","url":"https://d/2"}]}}]}', ("https://d/2", "T", ["A B"])),
    "hal": ('{"response":{"docs":[{"title_s":["T"],"uri_s":"https://h/1","authFullName_s":["A B"]}]}}', ("https://h/1", "T", ["A B"])),
    "semanticscholar": ('{"data":[{"title":"T","openAccessPdf":null,"authors":[{"name":"A B"}]}]}', None),
    "crossref": ('{"message":{"items":[{"title":["T"],"author":[{"given":"A","family":"B"}],"link":[{"URL":"https://c/1",'
                 '"content-type":"application/pdf"}]}]}}', ("https://c/1", "T", ["A B"])),
    "core": ('{"results":[{"title":"T","downloadUrl":null,"links":[{"type":"download","url":"https://k/1"}],'
             '"authors":[{"name":"A B"}]}]}', ("https://k/1", "T", ["A B"])),
}


def test_mappers(spark):
    pages = spark.createDataFrame([(k, "c", p) for k, (p, _) in PAYLOADS.items()] + [("hal", "c", "not json")],
                                  "source string, concept string, payload string")
    got = {r["source"]: (r["url"], r["title"], r["authors"]) for r in C.harvest(pages).collect()}
    assert got == {k: v for k, (_, v) in PAYLOADS.items() if v}


def test_oai(spark):
    rec = lambda status, title, subject: (
        f'<record><header{status}/><metadata><oai_dc:dc xmlns:oai_dc="o" xmlns:dc="d"><dc:title>{title}</dc:title>'
        f"<dc:creator>Ann Lee</dc:creator><dc:creator>Bo Ng</dc:creator><dc:subject>{subject}</dc:subject>"
        "<dc:identifier>oai:1</dc:identifier><dc:identifier>https://o/1</dc:identifier></oai_dc:dc></metadata></record>"
    )
    xml = ('<OAI-PMH xmlns="x"><ListRecords>' + rec("", "The Kingdom of Kush", "s") + rec(' status="deleted"', "Kush", "s")
           + rec("", "Other", "s") + "<record><header/></record><resumptionToken>t</resumptionToken></ListRecords></OAI-PMH>")
    pages = spark.createDataFrame([("uct", xml)], "source string, payload string")
    concepts = spark.createDataFrame([("Kush",), ("Kingdom of Kush",)], "c string")
    rows = C.oai_pmh(pages, lambda df, text, out: concept_label(df, text, concepts, "c", out)).collect()
    assert [(r["source"], r["concept"], r["url"], r["authors"]) for r in rows] == [
        ("oai:uct", "Kingdom of Kush", "https://o/1", ["Ann Lee", "Bo Ng"])
    ]


def test_author_evidence(spark):
    rows = [
        (1, "archive.org", '{"metadata":{"creator":["A One; B Two","elgamelyan"]}}'),
        (2, "archive.org", '{"metadata":{"creator":"UNESCO"}}'),
        (3, "crossref:doi", '{"message":{"author":[{"given":"Ann","family":"Lee"},{"name":"Big Institute"}]}}'),
        (4, "eric", '{"response":{"docs":[]}}'),
    ]
    got = C.author_evidence(spark.createDataFrame(rows, "key int, kind string, payload string")).collect()
    assert {r["key"]: r["authors"] for r in got} == {1: ["A One", "B Two"], 2: ["UNESCO"], 3: ["Ann Lee", "Big Institute"]}


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "mali.md").write_text("---\ntitle: The Mali Empire\nera: 1235–1600 CE\nregion: West Africa\n---\n\nBody: x\n---\nmore\n")
    (tmp_path / "plain.txt").write_text("  no header\n")
    (tmp_path / "open.md").write_text("---\ntitle: never closed\n")
    (tmp_path / "skip.pdf").write_text("x")
    rows = {r["source_path"].rsplit("/", 1)[-1]: r for r in S.parse_corpus(S.read_corpus(spark, str(tmp_path))).collect()}
    assert set(rows) == {"mali.md", "plain.txt", "open.md"}
    mali = rows["mali.md"]
    assert (mali["title"], mali["era"], mali["region"]) == ("The Mali Empire", "1235–1600 CE", "West Africa")
    assert mali["body"] == "Body: x\n---\nmore"
    assert (rows["plain.txt"]["title"], rows["plain.txt"]["body"], rows["plain.txt"]["era"]) == ("plain", "  no header\n", None)
    assert rows["open.md"]["meta"] == {}


def test_upsert_and_chunks(spark):
    docs = "id string, source_path string, title string"
    now = spark.createDataFrame([("i1", "a", "old"), ("i2", "b", "keep")], docs)
    new = spark.createDataFrame([("a", "new"), ("c", "fresh")], "source_path string, title string")
    got = {r["source_path"]: (r["id"], r["title"]) for r in S.upsert_documents(now, new).collect()}
    assert got["a"] == ("i1", "new") and got["b"] == ("i2", "keep") and got["c"][1] == "fresh" and got["c"][0]
    chunks = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 0)], "source_path string, n int")
    fresh = spark.createDataFrame([("a", 0), ("a", 1)], "source_path string, n int")
    kept = sorted(tuple(r) for r in S.replace_chunks(chunks, fresh, new).collect())
    assert kept == [("a", 0), ("a", 1), ("b", 0)]


def test_snapshot_insert_cascade(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, t string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k int, t string")
    assert {r["k"]: r["status"] for r in S.snapshot_diff(old, new, "k", "t").collect()} == {
        1: "same", 2: "changed", 3: "deleted", 4: "new"
    }
    assert sorted(r["t"] for r in S.insert_absent(old, new, ["k"]).collect()) == ["a", "b", "c", "d"]
    assert [r["k"] for r in S.cascade_delete(old, new, "k").collect()] == [3]


def test_ledger(spark, tmp_path):
    path = tmp_path / "ledger.csv"
    path.write_text(
        "Subject,Source,Hyperlink,Title,Open,Author,verdict,downloaded\n"
        's, x.org ,https://x.org/1,"A, ""T""",TRUE,,TRUE,FALSE\n'
        "s,x.org,https://x.org/2,T,TRUE,A B,TRUE,FALSE,failed: HTTP 404 (no longer there)\n"
        "s,x.org,ftp://x.org/3,T,TRUE,A B,TRUE,FALSE,\ns,x.org,https://x.org/4,T,TRUE,A B,TRUE,TRUE,\ns,x.org,https://x.org/5,T,TRUE,A B,,FALSE,\n"
    )
    rows = L.read_ledger(spark, str(path))
    first = rows.where("hyperlink LIKE '%1'").first()
    assert (first["source"], first["title"], first["note"]) == ("x.org", 'A, "T"', "")
    assert [r["hyperlink"] for r in L.pending_rows(rows).collect()] == ["https://x.org/1"]
    assert L.pending_rows(rows, retry_failed=True).count() == 2
    assert L.pending_rows(rows, retry_failed=True, limit=1).count() == 1
    assert L.missing_authors(rows).count() == 1


def test_guarded_backfill(spark):
    ledger = spark.createDataFrame([(1, "u1", ""), (2, "moved", ""), (3, "u3", "has"), (4, "u4", "")],
                                   "row_no int, hyperlink string, authors string")
    updates = spark.createDataFrame([(1, "u1", "N1"), (2, "u2", "N2"), (3, "u3", "N3")], "row_no int, hyperlink string, value string")
    got = {r["row_no"]: (r["authors"], r["outcome"]) for r in L.guarded_backfill(ledger, updates, "authors").collect()}
    assert got == {1: ("N1", "written"), 2: ("", "skipped_moved"), 3: ("has", "kept"), 4: ("", "no_update")}


def test_validate_rows(spark):
    rows = [(" a\n b ", "s", "https://x.org/1", "", ""), ("a", "s", "http://", "t", ""), ("a", "s", "ftp://x.org/1", "t", ""),
            ("a", "s", "https://x.org/1", "t" * 501, "")]
    df = spark.createDataFrame(rows, "subject string, source string, hyperlink string, title string, authors string")
    out = L.validate_rows(df).collect()
    assert [r["reject_reason"] for r in out] == [None, "bad_url_length", "not_http", "title_too_long"]
    assert (out[0]["subject"], out[0]["title"]) == ("a b", "Unknown")


def test_sniff(spark):
    rows = [
        ("a.pdf", b"\x89PNG\r\n\x1a\n0", "image/png"), ("a.pdf", b"MZ\x90", None), ("a.txt", b"PK\x03\x04zip", None),
        ("a.bin", b"PK\x03\x04..word/document.xml..", FI.DOCX), ("a.MD", "été".encode(), "text/markdown"), ("a.txt", b"\xff\xfe", None),
        ("noext", b"text", None), ("x.gif", b"GIF87a", "image/gif"), ("x", b"%PDF-1", "application/pdf"), ("x", b"RIFF0000WEBP", "image/webp"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "f string, c binary")
    got = [r[0] for r in df.select(FI.sniff_type(F.col("c"), F.col("f"))).collect()]
    assert got == [r[2] for r in rows]


def test_extract(spark):
    rows = [('{"a":1,"b":[2,3]}', "application/json"), ("", "text/plain"), (None, "text/plain"), ("x" * 20_001, "text/plain"),
            ("{bad", "application/json"), (None, "image/png")]
    out = FI.extract_text(spark.createDataFrame(rows, "text string, content_type string")).collect()
    assert [r["extraction_status"] for r in out] == ["ok", "empty", "failed", "truncated", "ok", "ok"]
    assert "\n" in out[0]["extracted_text"] and out[0]["line_count"] == 7
    assert len(out[3]["extracted_text"]) == 20_000 and out[3]["truncated_to_chars"] == 20_000
    assert out[4]["extracted_text"] == "{bad" and out[5]["kind"] == "image"


def test_sidecar(spark):
    rows = [
        {"title": t, "author": a, "source_url": u, "host": "h", "concept": c, "open_access": o}
        for t, a, u, c, o in [
            ("T", "A", "https://x", "c", True), ('quo"te\\ é\n' * 40, "B" * 300, "https://x/" + "é" * 400, "c", False),
            ("é" * 300, "ü" * 200, "u", "k" * 150, True), ("t" * 300, "a" * 200, "u", "é" * 480, True),
        ]
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in rows],
                               "title string, author string, source_url string, host string, concept string, open_access boolean")
    got = [r["sidecar"] for r in FI.sidecar_json(df, constants={"judged": True}).collect()]
    size = lambda attrs: len(json.dumps({"metadataAttributes": attrs}, ensure_ascii=False).encode())
    for row, text in zip(rows, got, strict=True):
        attrs, whole = json.loads(text)["metadataAttributes"], {**row, "title": row["title"][:300], "author": row["author"][:200], "judged": True}
        assert size(attrs) == len(text.encode()) and (size(attrs) <= 1000 or attrs["title"] == "")
        assert ("source_url" in attrs) == (size(whole) <= 1000)
        # the title loses steps of 20 characters, and no step more than it takes
        n = len(attrs["title"])
        assert whole["title"].startswith(attrs["title"])
        if n < len(whole["title"]):
            assert n == 0 or (len(whole["title"]) - n) % 20 == 0
            assert size({**attrs, "title": whole["title"][: min(n + 20, len(whole["title"]))]}) > 1000
        assert {k: v for k, v in attrs.items() if k not in ("title", "source_url")} == {k: v for k, v in whole.items() if k not in ("title", "source_url")}
    assert [len(json.loads(t)["metadataAttributes"]["title"]) for t in got][:2] == [1, 300]


def test_report_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "failed", "n", 0, "u", "t")], "row int, outcome string, note string, bytes long, url string, title string")
    FI.write_report(df, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first()["outcome"] == "failed"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_bytes(b"x")
    assert FI.read_files(spark, str(tmp_path / "f")).first()["filename"] == "a.txt"


def test_reference(spark, tmp_path):
    (tmp_path / "soft_drinks.json").write_text(json.dumps({"category": "Soft drinks", "core_machines": [
        {"name": "Filler", "purpose": "fill", "typical_cost_usd": 9000}]}))
    cats = R.read_categories(spark, str(tmp_path))
    regions = spark.createDataFrame([("West", 180)], "region string, labour int")
    asks = spark.createDataFrame([(1, " Soft Drinks ", "West"), (2, "Tyres", "East")], "id int, category string, region string")
    out = {r["id"]: r for r in R.attach_reference(asks, cats, regions).collect()}
    assert out[1]["core_machines"][0]["name"] == "Filler" and out[1]["labour"] == 180
    assert out[2]["core_machines"] is None and out[2]["labour"] is None
    assert R.machine_rows(cats).first()["typical_cost_usd"] == 9000.0


def test_validate_json(spark):
    def check(spec, **value):
        r = validate_json(spark.createDataFrame([(json.dumps(value),)], "j string"), "j", spec).first()
        return r["invalid"], r["value"]

    bad, part = check(PART_SPEC, name="p", length=1, width=2, height=3)
    assert bad is None and part["units"] == "mm" and part["wall_thickness"] == 2.0 and part["features"] == []
    assert check(PART_SPEC, name="p", length=0, width=2, height=3)[0] == "length"
    assert check(PART_SPEC, name="p", length=1, width=2, height=3, units="ft")[0] == "units"
    assert check(PART_SPEC, length=1, width=2, height=3)[0] == "name"
    assert check(PART_SPEC, name="p", length=1, width=2, height=3, tolerance=-1)[0] == "tolerance"
    assert check(CAPTION_SPEC, expectation="a", reality="b")[0] == "caption"
    bad, plan = check(PLAN_SPEC, machines=[{"name": "m", "purpose": "p", "estimated_cost_usd": 1}], process_flow=["x"], cost_breakdown=[])
    assert bad is None and plan["machines"][0]["estimated_cost_usd"] == 1.0
    none = validate_json(spark.createDataFrame([("nope",)], "j string"), "j", PART_SPEC).first()
    assert none["invalid"] == "not_json"


def test_snapshot_of_null_content(spark):
    old = spark.createDataFrame([("a", None), ("b", None), ("c", "x"), ("d", "y")], "k string, t string")
    new = spark.createDataFrame([("a", None), ("b", "now"), ("c", None), ("e", None)], "k string, t string")
    from corpusflow.sources.corpus import snapshot_diff

    got = {r["k"]: r["status"] for r in snapshot_diff(old, new, "k", "t").collect()}
    assert got == {"a": "same", "b": "changed", "c": "changed", "d": "deleted", "e": "new"}


def test_title_evidence_takes_the_first_near_work_with_an_author(spark):
    item = lambda title, *names: {"title": [title], "author": [{"given": g, "family": f} for g, f in names]}
    import json

    listed = [item("Another book", ("No", "One")), item("The Gold Trade of Mali."), item("The gold trade of Malí", ("Ann", "Lee")), item("The gold trade of Mali", ("Bo", "Ng"))]
    answers = [(1, "crossref:title", json.dumps({"message": {"items": listed}})), (2, "openalex:title", "not json"), (3, "eric", "{}")]
    frame = spark.createDataFrame(answers, "key int, kind string, payload string")
    titles = spark.createDataFrame([(1, 'Full text of "The gold trade of Mali"'), (2, None)], "key int, title string")
    got = C.title_evidence(frame, titles).collect()
    assert [(r["key"], r["method"], r["authors"]) for r in got] == [(1, "crossref:title", ["Ann Lee"])]


def test_harvest_meets_every_answer(spark, sf, monkeypatch):
    from corpusflow.plans import discovery

    met, pmh = [], C.oai_pmh
    monkeypatch.setattr(discovery.C, "oai_pmh", lambda answers, label: met.append(answers.count()) or pmh(answers, label))
    discovery.harvest_oai(spark, sf)
    assert met == [spark.read.parquet(f"{sf}/pages.parquet").count()]
