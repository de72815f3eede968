"""Ordered tables, guarded tables and the insides of files."""

import pathlib
import struct
import tempfile
import zlib

import pytest
from pyspark.sql import functions as F

from tallyweave import registry
from tallyweave.operators import evals, guards, ledger, partners, policy
from tallyweave.plans import verify
from tallyweave.schemas import CHECK
from tallyweave.sources import ordered, projection, stores, structure
from tallyweave.sources.stores import store
from tallyweave.streaming import arrivals


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(wide=40, high=30, laced=0, step=200, rows=None):
    pixels = zlib.compress(b"".join(b"\0" + bytes((x * y) % 251 for x in range(wide * 3)) for y in range(rows or high)))
    parts = [chunk(b"IDAT", pixels[i : i + step]) for i in range(0, len(pixels), step)]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, laced)) + b"".join(parts) + chunk(b"IEND", b""), parts


def jpeg(marks=range(10), scans=1):
    segment = lambda mark, data: b"\xff" + bytes([mark]) + struct.pack(">H", len(data) + 2) + data
    scan = segment(0xDA, b"\1\1\0\0\x3f\0") + b"".join(b"pixels\xff\0" + b"\xff" + bytes([0xD0 + m % 8]) for m in marks) + b"end"
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0") + b"\xff" + segment(0xC2, b"\x08\0\1\0\1\1\1\x11\0") + scan * scans + b"\xff\xd9"


def pdf(updated=False, packed=False, lead=b""):
    body, at = b"%PDF-1.5\n", {}
    for n in (1, 2, 3):
        at[n] = len(body)
        body += b"%d 0 obj\n<< /Kind %d >>\nendobj\n" % (n, n)
    table, start = b"xref\n0 4\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % at[n] for n in at), len(body)
    if packed:
        table = b"4 0 obj\n<< /Type /XRef /Length 3 >>\nstream\nabc\nendstream\nendobj\n"
    body += table + (b"" if packed else b"trailer\n<< /Size 4 >>\n") + b"startxref\n%d\n%%%%EOF\n" % start
    if updated:
        new = len(body)
        body += b"2 0 obj\n<< /Kind 9 >>\nendobj\n"
        second = len(body)
        body += b"xref\n2 1\n%010d 00000 n \ntrailer\n<< /Size 4 /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (new, start, second)
    return lead + body


def test_insides_of_files():
    whole, parts = png()
    assert len(parts) > 3 and structure.png_fault(whole) is None
    assert structure.png_fault(png(laced=1)[0]) is None
    assert structure.png_fault(whole[: len(whole) // 2]) == structure.CUT and structure.png_fault(whole[:-12]) == structure.CUT
    assert structure.png_fault(whole.replace(parts[1], b"")) == structure.DAMAGED  # a chunk gone: checksums hold, pixels do not
    assert structure.png_fault(png(rows=29)[0]) == structure.DAMAGED
    assert structure.png_fault(whole.replace(b"".join(parts), b"")) == structure.NO_PIXELS
    for i in range(8, len(whole) - 12, 37):
        assert structure.png_fault(whole[:i] + bytes([whole[i] ^ 1]) + whole[i + 1 :]), i
    assert structure.jpeg_fault(jpeg()) is None and structure.jpeg_fault(jpeg(scans=3)) is None
    assert structure.jpeg_fault(jpeg(marks=[0, 1, 3])) == structure.DAMAGED
    assert {structure.jpeg_fault(jpeg()[:n]) for n in range(2, len(jpeg()))} == {structure.CUT}
    assert structure.jpeg_fault(b"\xff\xd8\xff\xd9") == structure.NO_PIXELS
    assert structure.jpeg_fault(b"GIF89a") == structure.png_fault(b"GIF89a") == structure.DAMAGED
    for good in (pdf(), pdf(updated=True), pdf(packed=True), pdf(lead=b"mail header\n")):
        assert structure.pdf_fault(good) is None
        assert structure.pdf_fault(good[:-6]) == structure.NO_END
    for middle in (20, 60):
        assert structure.pdf_fault(pdf()[:middle] + pdf()[middle + 1 :]) == structure.BAD_INDEX
        assert structure.pdf_fault(pdf(updated=True)[:middle] + b"x" + pdf(updated=True)[middle:]) == structure.BAD_INDEX
    assert structure.pdf_fault(b"%PDF-1.4\n%%EOF") == structure.NO_INDEX


def test_faults_as_a_column(spark):
    files = [(0, "png", png()[0]), (1, "png", png()[0][:300]), (2, "pdf", pdf()), (3, "jpg", b""), (4, "webp", b"x"), (5, "pdf", None), (6, None, b"x"), (7, "jpeg", jpeg())]
    frame = spark.createDataFrame(files, "id int, kind string, content binary").withColumn("fault", structure.fault(F.col("content"), F.col("kind")))
    assert {r.id: r.fault for r in frame.collect()} == {0: None, 1: structure.CUT, 2: None, 3: "the file is empty", 4: None, 5: None, 6: None, 7: None}


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """20,000 rows in three sections, one of them holding most, in forty files."""
    path = str(tmp_path_factory.mktemp("ordered with blank") / "queue")
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 7, 1).when(F.col("id") % 10 == 7, 0).otherwise(9).alias("rank"), ((F.col("id") * 7919) % 20_011).alias("arrival"), "id")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered.write_ordered(rows, path, "rank", "arrival")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path, sorted((r.rank, r.arrival, r.id) for r in rows.collect())


def test_order_is_that_of_the_files(spark, kept):
    path, wanted = kept
    placed = {r.place: (r.rank, r.arrival, r.id) for r in ordered.placed(spark, path, "rank").collect()}
    assert [placed[i + 1] for i in range(len(wanted))] == wanted


def test_pages_and_lookups_open_few_files(spark, kept):
    path, wanted = kept
    files = len(spark.read.parquet(f"{path}/rows").inputFiles())
    assert files > 30
    after, got = None, []
    while True:
        page = ordered.page(spark, path, "rank", "arrival", 3_000, after)
        rows = [tuple(r) for r in page.collect()]
        if not rows:
            break
        assert len(page.inputFiles()) <= 8
        got += rows
        after = rows[-1][:2]
    assert got == wanted
    assert [tuple(r) for r in ordered.page(spark, path, "rank", "arrival", 5, (0, 10**9)).collect()] == [w for w in wanted if w[0] > 0][:5]
    for w in wanted[::4_001]:
        found = ordered.find(spark, path, "arrival", w[1])
        assert [tuple(r) for r in found.collect()] == [w] and len(found.inputFiles()) <= 6
    assert ordered.find(spark, path, "arrival", -1).count() == 0


def test_an_empty_ordered_table(spark, tmp_path):
    ordered.write_ordered(spark.createDataFrame([], "rank int, arrival bigint"), str(tmp_path / "q"), "rank", "arrival")
    assert ordered.page(spark, str(tmp_path / "q"), "rank", "arrival", 5).count() == ordered.find(spark, str(tmp_path / "q"), "arrival", 1).count() == ordered.placed(spark, str(tmp_path / "q"), "rank").count() == 0


def test_planted_breaks_are_found_in_the_writing_job(spark, tmp_path):
    rows = [(1, "P", "a", 0, "order"), (2, "P", "a", 0, "key"), (3, "P", "b", 5, None), (4, None, "a", 0, ""), (5, None, "a", 0, ""), (6, "Q", "c", None, "x"), (6, "Q", "c", 7, "y"), (7, "Q", "c", 0, "z"), (8, "P", "b", 1, "w")]
    # clashing names on purpose; `row` is a column too
    frame = spark.createDataFrame(rows, "id int, partner string, number string, `key_0` int, row string")
    sound, apart, counts = guards.store_guarded(frame, str(tmp_path / "t"), "id", {"number": ("partner", "number")}, {"amount": F.col("key_0") > 0})
    assert counts == {"rows": 9, "number": 5, "amount": 3}
    assert sorted((r.id, r.rules_broken) for r in apart.collect()) == [(2, ["number"]), (3, ["amount"]), (6, ["amount", "number"]), (6, ["number"]), (7, ["number"]), (8, ["amount", "number"])]
    assert sorted(r.id for r in sound.collect()) == [1, 4, 5] and sound.columns == frame.columns
    none = guards.store_guarded(frame.limit(0), str(tmp_path / "e"), "id", {"number": ("partner", "number")})
    assert none[2] == {"rows": 0, "number": 0} and none[0].count() == none[1].count() == 0


def test_a_key_that_a_third_of_rows_share(spark, tmp_path):
    frame = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    sound, apart, counts = guards.store_guarded(frame, str(tmp_path / "h"), "id", {"once": ("k",)})
    assert counts == {"rows": 60_000, "once": 19_999} and apart.count() == 19_999 and sound.filter("k = 'hot'").first().id == 0


def test_nothing_of_the_master_is_broadcast_whatever_its_files_seem_to_hold(spark, tmp_path):
    """Short files of many names, segments and numbers look small; only the few lengths of keys may be broadcast."""
    people = spark.range(500).select(
        F.format_string("P-%06d", "id").alias("partner_code"), F.format_string("Maker#%05d", "id").alias("name"), F.array(F.format_string("Maker%05d", "id")).alias("aliases"),
        F.format_string("T%013d", "id").alias("registration_no"), F.col("id").alias("ord"),
    )
    asked = spark.range(40).select(F.col("id").alias("arrival"), F.format_string("Maker#%04d", "id").alias("supplier_name"), F.lit("").alias("registration_no"))
    people, asked = store(people, str(tmp_path / "people")), store(asked, str(tmp_path / "asked"))
    found = partners.resolve(asked, people)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert all("length" in line for line in joins), joins
    assert {r.method for r in found.collect()} == {"FUZZY_NAME"}


def test_queries_of_few_columns_read_the_tables_once_and_build_no_layer(spark):
    sf_dir = "/root/testdata/sf0.001"
    stores.forget_layers()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for name in ("normalize_header", "parse_date", "parse_amount", "tax_base"):
        registry.QUERIES[name](spark, sf_dir)
    assert stores.stored_layer(spark, sf_dir, "normalized") is None
    # the order's invoice and its two kinds of copies
    assert plan(registry.QUERIES["json_recover"](spark, sf_dir)).count("Relation [o_orderkey") == 3


def test_only_what_is_compared_of_lines_is_joined(spark):
    line = "array<struct<description:string,amount:bigint,tax_code:string>>"
    fields = ", ".join(f"{c} string" for c in ("registration_no", "invoice_number", "issue_date", "due_date", "subtotal", "tax_amount", "total_amount"))
    truth = spark.createDataFrame([], f"name bigint, {fields}, lines {line}")
    got = truth.withColumns({"model": F.lit("m"), "error": F.lit(None).cast("string")})
    plan = evals.compare(truth, got)._jdf.queryExecution().analyzed()
    join = next(p for p in iter(lambda it=[plan]: it.__setitem__(0, it[0].children().apply(0)) or it[0], None) if p.nodeName() == "Join")
    assert "description" not in join.output().toString() + join.schema().simpleString()


def test_customers_and_lines_are_not_broadcast_to_orders(spark):
    """Files of few megabytes hold a million names, and packed lines of copies are many times their shuffled size."""
    plan = projection.raw_invoices(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_matching_is_planned_once_however_often_its_rows_are_taken(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    people = spark.createDataFrame([("P-1", "Maker#00001", ["Maker00001"], "T1", 1)], "partner_code string, name string, aliases array<string>, registration_no string, ord bigint")
    rows = spark.createDataFrame([(1, "Maker#0001", "", "P-9", [])], f"arrival bigint, supplier_name string, registration_no string, partner_code string, checks array<{CHECK}>")
    monkeypatch.setattr(policy.verify, "judge", lambda carried, *_, **__: carried)
    again = policy.judged_again(rows, rows.selectExpr("arrival", "partner_code", "'' as invoice_number", "0L as total_amount", "current_date() as issue_date", "'' as status"), master=people)
    assert "Join" not in plan(again)
    assert [(r.partner_code, r.method) for r in again.collect()] == [("P-1", "FUZZY_NAME")]
    # close names are read where they are stored: the master is cut up for segments, on one side of one join, and counted
    found = partners.fuzzy_matches(rows.selectExpr("'maker#0001' as name_key"), people)
    assert plan(found).count("Join") <= 5
    assert [tuple(r)[:2] for r in found.collect()] == [("maker#0001", "P-1")]


def test_checks_registration_and_postings_broadcast_nothing_that_grows(spark, monkeypatch):
    """Under a limit that lets every table be broadcast, only the few lengths of keys and the counts of ranges are, in what
    the queries write down on their way too."""
    plans, plain = [], stores.store
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    for module in (stores, partners, ledger, verify):
        monkeypatch.setattr(module, "store", lambda df, path=None: plain(planned(df), path))
    stores.forget_layers()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        for name in ("check_1", "check_10", "check_12", "auto_gate", "postings"):
            planned(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # the five, their layers, and what matching and numbering write down
    assert len(plans) >= 11
    joins = [line for plan in plans for line in plan.splitlines() if "Broadcast" in line and "Join" in line]
    assert joins and all("length" in line or "_part" in line for line in joins), joins


def test_queries_of_few_columns_leave_no_text_of_an_invoice_unread(spark):
    """F16: without the layer too, lines and amounts are read for a query that shows neither."""
    sf_dir = "/root/testdata/sf0.001"
    stores.forget_layers()
    for name in ("normalize_header", "parse_date", "parse_amount"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert all(text in plan for text in ("Relation [l_orderkey", "quantity_raw", "tax_rate_raw", "bank_details_raw", "total_amount_raw", "issue_date_raw")), name


def folder_mb(path):
    return sum(f.stat().st_size for f in path.rglob("*") if f.is_file()) / 1e6


def test_shuffles_go_with_the_job_that_stores_a_frame(spark, tmp_path):
    """Shuffle files of a stored layer stay on no disk, and the session's settings are as they were."""
    before = {k: spark.conf.get(k, None) for k in stores.STORING}
    shuffled = lambda: sum(folder_mb(d) for root in pathlib.Path(spark.conf.get("spark.local.dir", tempfile.gettempdir())).glob("blockmgr-*") for d in [root])
    held = shuffled()
    rows = spark.range(400_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).repartition(8, "text")
    assert store(rows, str(tmp_path / "rows")).count() == 400_000
    assert shuffled() - held < 10
    assert {k: spark.conf.get(k, None) for k in stores.STORING} == before


def test_whole_invoices_are_dealt_once_for_a_judgement(spark):
    """Matching and duplicates go without the lines; one join puts what they tell to the whole invoices."""
    sf_dir = "/root/testdata/sf0.001"
    rows = verify.judge(registry.matched(spark, sf_dir), projection.PROJECTED_POLICY, rest=registry.normalized(spark, sf_dir))
    scans = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert len(scans) > 2 and sum("lines#" in line.split("]")[0] for line in scans) == 1
    assert "lines" not in registry.matched(spark, sf_dir).columns


def test_requests_are_judged_without_their_lines(spark, monkeypatch):
    """What the ledger says of a request is written down by arrival, and whole requests are joined once."""
    told, plain = [], ledger.store
    monkeypatch.setattr(ledger, "store", lambda df, path=None: told.append(df.columns) or plain(df, path))
    people = spark.createDataFrame([("P-1",)], "partner_code string")
    line = "array<struct<description:string,quantity:bigint,unit:string,unit_price:bigint,amount:bigint,tax_code:string>>"
    asked = [(1, "P-1", "A", 100, 10, 110, "T10"), (2, "P-1", "A", 100, 10, 110, "T10"), (3, "P-9", "B", 100, 10, 110, "T10"), (4, "P-9", "C", 100, 10, 110, "T99"), (5, "P-1", "D", 100, 10, 111, "T10")]
    rows = [(a, p, n, "2026-01-01", "2026-02-01", "JPY", [("x", 1, "pc", 100, 100, code)], s, t, total) for a, p, n, s, t, total, code in asked]
    requests = spark.createDataFrame(rows, f"arrival bigint, partner_code string, invoice_number string, issue_date string, due_date string, currency string, lines {line}, subtotal bigint, tax_amount bigint, total_amount bigint")
    answers, records = ledger.admit(requests, people)
    assert {r.arrival: (r.error_code, r.accounting_id) for r in answers.collect()} == {1: (None, "ACC-0001"), 2: ("DUPLICATE_INVOICE", None), 3: ("PARTNER_NOT_FOUND", None), 4: ("PARTNER_NOT_FOUND", None), 5: ("AMOUNT_MISMATCH", None)}
    assert records.count() == 1 and told[0] == ["arrival", "error_code", "error_message"] and not any("lines" in columns for columns in told)


def test_a_batch_writes_one_file_for_each_bucket(spark, tmp_path):
    """not one of every task for each."""
    rows = spark.range(20_000).withColumn("bucket", (F.col("id") % 16).cast("int")).repartition(8)
    arrivals.write_batch(rows, str(tmp_path / "t"), 0, "bucket")
    assert len(list((tmp_path / "t").rglob("*.parquet"))) == 16 and spark.read.parquet(str(tmp_path / "t")).count() == 20_000
