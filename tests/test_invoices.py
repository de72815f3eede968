"""From raw transcriptions to the ledger: a master and invoices planned by the paths they are to take."""

import json
import random
import shutil
import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S
from tallyweave.operators import checks, dedupe, ledger, normalize, partners, policy, review
from tallyweave.plans import casework, verify
from tallyweave.schemas import POLICY
from tallyweave.sources import intake
from tallyweave.streaming import arrivals, figures, keyed

NAMES = [("青葉印刷株式会社", "Aoba Print"), ("有限会社 北浜電機", "Kitahama"), ("みどり食品", "Midori"), ("港南運輸", "Konan Lines"), ("合同会社空色", "Sorairo"), ("白川石材", "Shirakawa"), ("Delta Works", "DW")]
PARTNERS = [(f"P-{i}", n, [a], f"T{i:013d}", i) for i, (n, a) in enumerate(NAMES, 2001)]


def invoice(supplier, number, base, **change):
    """Two lines, one of ten and one of eight per cent; printed amounts hold unless changed."""
    reduced = base // 4
    tax = base // 10 + reduced * 8 // 100
    record = {
        "supplier_name": supplier, "supplier_registration_no": "", "invoice_number": number, "issue_date_raw": "令和8年1月7日", "due_date_raw": "2026/02/28",
        "subtotal_raw": f"¥{base + reduced:,}", "tax_amount_raw": str(tax), "total_amount_raw": f"{base + reduced + tax:,}円",
        "lines": [
            {"description": "works", "quantity_raw": "2", "unit": "個", "unit_price_raw": f"{base // 2:,}", "amount_raw": f"{base:,}", "tax_rate_raw": "10%"},
            {"description": "food", "quantity_raw": "", "unit": "", "unit_price_raw": "", "amount_raw": f"{reduced}", "tax_rate_raw": "8%"},
            {"description": "", "amount_raw": "5"},
        ],
        "tax_breakdown": [{"rate_raw": "10%"}, {"rate_raw": "8%"}], "ignored": 1,
    }
    return record | change


#: Each path with its invoice and the state it ends in, in order of arrival.
PATHS = {
    "alias": (invoice("Kitahama", "K/77", 48000), "POSTED"),
    "first": (invoice("みどり食品", "M-5", 252000), "POSTED"),
    "unknown": (invoice("どこか商会", "Q-1", 90000), "BLOCKED"),
    "limit": (invoice("港南運輸", "T-900", 2200000), "NEEDS_REVIEW"),
    "twin": (invoice("みどり食品 御中", "m-5 ", 252000), "BLOCKED"),
    "number": (invoice("青葉印刷", "S-1", 66000, supplier_registration_no="T-0000000002001"), "POSTED"),
    "account": (invoice("空色", "X-1", 130000, handwritten_annotations=[{"text": "pay here", "location": "bank", "affects_payment_details": True}]), "NEEDS_REVIEW"),
    "total": (invoice("白川石材", "R-3", 76000, total_amount_raw="12"), "NEEDS_REVIEW"),
    "margin": (invoice("DW", "D-20", 310000, handwritten_annotations=[{"text": "thanks", "location": "margin", "affects_payment_details": False}]), "POSTED"),
    "plain": (invoice("白川石材", "R-4", 44000), "POSTED"),
    "kanji": (invoice("Delta Works 様", "D-21", 520000, due_date_raw="2026年3月31日"), "POSTED"),
    "empty": (invoice("港南運輸", "T-901", 20000, lines=[]), "BLOCKED"),
    "undated": (invoice("Konan Lines", "T-902", 28000, due_date_raw="soon"), "NEEDS_REVIEW"),
    "near": (invoice("白川石材", "R-5", 44000), "NEEDS_REVIEW"),
}
RAW, WANTED = [r for r, _ in PATHS.values()], [w for _, w in PATHS.values()]
AT = {name: i for i, name in enumerate(PATHS)}


@pytest.fixture(scope="module")
def done(spark):
    master = spark.createDataFrame(PARTNERS, "partner_code string, name string, aliases array<string>, registration_no string, ord int")
    answers = spark.createDataFrame([(i, f"```json\n{json.dumps(r)}\n```") for i, r in enumerate(RAW)] + [(99, "no json here {")], "arrival bigint, answer string")
    records, failures = intake.raw_records(answers)
    checked = verify.verify(records, master).cache()
    posted, new = verify.register(checked, master)
    return {"master": master, "failures": failures, "checked": checked, "posted": posted.cache(), "records": new}


def test_every_way_through(done):
    rows = done["posted"].orderBy("arrival").collect()
    assert [r.status for r in rows] == WANTED
    bad = {name: {c.name for c in rows[i].checks if not c.passed and c.severity != "WARN"} for name, i in AT.items()}
    alone = {"limit": "amount.threshold", "twin": "dedupe.exact", "account": "handwriting.on_payment_details", "total": "arithmetic.total", "unknown": "partner.resolved", "undated": "dates.parsed", "near": "dedupe.near"}
    assert {name: bad[name] for name in alone} == {name: {check} for name, check in alone.items()} and "extraction.lines_present" in bad["empty"]
    assert all(17 <= len(r.checks) <= 20 for r in rows) and rows[0].lines[1].unit == "" and len(rows[0].lines) == 2
    assert rows[AT["number"]].method == "REGISTRATION_NO" and rows[AT["alias"]].method == "ALIAS"
    assert done["failures"].collect()[0].status == "EXTRACT_FAILED"


def test_ledger_numbers_and_second_run(spark, done):
    records = done["records"].orderBy("accounting_id").collect()
    assert [r.accounting_id for r in records] == [f"ACC-{i:04d}" for i in range(1, 7)]
    assert all(r.total_amount == r.subtotal + r.tax_amount for r in records)
    again, new = verify.register(done["checked"], done["master"], held=done["records"])
    assert new.count() == 0
    refused = again.filter("error_code = 'DUPLICATE_INVOICE'").collect()
    assert len(refused) == 6 and all(r.status == "BLOCKED" and r.checks[-1].name == "accounting.accepted" for r in refused)


def test_ledger_refuses_shapes(spark, done):
    good = ledger.build_payload(done["checked"].filter("arrival = 0")).drop("gap")
    faults = {"issue_date": "2026-02-30", "currency": "USD", "invoice_number": "", "due_date": "26-01-01", "partner_code": "P-9"}
    rows = good.withColumn("arrival", F.lit(0).cast("bigint"))
    for i, (c, v) in enumerate(faults.items(), 1):
        rows = rows.unionByName(good.withColumns({"arrival": F.lit(i).cast("bigint"), c: F.lit(v)}))
    codes = [r.error_code for r in ledger.judge(rows, done["master"]).orderBy("arrival").collect()]
    assert codes == [None, "VALIDATION_ERROR", "VALIDATION_ERROR", "VALIDATION_ERROR", "VALIDATION_ERROR", "PARTNER_NOT_FOUND"]


def test_review(spark, done):
    asked = [("limit", "ann", None, None), ("account", "ann", None, None), ("total", "bob", "pay_altered", "ok"), ("unknown", "bob", None, None), ("plain", "ann", None, None)]
    approvals = spark.createDataFrame([(AT[a], *rest) for a, *rest in asked], "arrival bigint, actor string, outcome string, note string")
    judged = {r.arrival: r for r in review.judge_approvals(done["posted"], approvals).collect()}
    assert {k: judged[AT[k]].result for k, *_ in asked} == {"limit": "send", "account": "payment decision missing", "total": "send", "unknown": "blocked", "plain": "already registered"}
    assert judged[AT["total"]].event_note == "ok; payment details: supplier confirmed the account changed; overrode 1 check(s): arithmetic.total"
    decided = spark.createDataFrame([(AT["account"], "ann", "supplier_unreachable", None, "12-3", "by mail")], "arrival bigint, actor string, outcome string, note string, account string, confirmed string")
    sent = review.judge_approvals(done["posted"], decided).first()
    assert sent.result == "send" and sent.event_note.startswith("payment details: supplier could not be reached; pay 12-3; by mail; overrode")
    assert review.judge_approvals(done["posted"], decided.withColumn("outcome", F.lit("printed"))).first().result == "payment decision missing"


def test_repeated_edits_and_rejections_leave_one_row(spark, done):
    edits = [(AT["unknown"], 1, "ann", "みどり食品", None), (AT["unknown"], 2, "bob", None, 7), (AT["unknown"], 3, "bob", "空色", None), (AT["plain"], 4, "ann", "x", None)]
    edited, events, refused = review.apply_edits(done["posted"], spark.createDataFrame(edits, "arrival bigint, event_id bigint, actor string, patch_supplier_name string, patch_total_amount bigint"))
    row = edited.filter(F.col("arrival") == AT["unknown"]).collect()
    assert [(r.supplier_name, r.total_amount) for r in row] == [("空色", 7)] and edited.count() == len(RAW) and refused.count() == 1
    told = [(json.loads(r.before), json.loads(r.after)) for r in sorted(events.collect(), key=lambda r: (r.after.count('"total_amount":7'), r.actor))]
    assert all(b["status"] == a["status"] == "BLOCKED" for b, a in told) and [b["total_amount"] == 7 for b, a in told].count(True) == 1
    rejects = spark.createDataFrame([(AT["limit"], 1, "a"), (AT["limit"], 2, None), (AT["plain"], 3, "b")], "arrival bigint, event_id bigint, note string")
    rows = {r.arrival: r for r in review.apply_rejects(done["posted"], rejects).collect()}
    assert len(rows) == len(RAW) and (rows[AT["limit"]].status, rows[AT["limit"]].reason) == ("REJECTED", "rejected by a reviewer") and rows[AT["plain"]].status == "POSTED"


CASES = "event_id bigint, arrival bigint, kind string, actor string, note string, outcome string, patch_partner_code string, patch_supplier_name string, patch_due_date date, patch_total_amount bigint"


def case(n, name, kind, note=None, outcome=None, **patch):
    return n, None if name is None else AT.get(name, 77), kind, "ann", note, outcome, *(patch.get(c) for c in ("partner_code", "supplier_name", "due_date", "total_amount"))


def test_cases_are_folded_in_order(spark, done):
    """Each name's events, what comes of them, and the state that they leave."""
    import datetime as dt

    events = [
        case(1, "unknown", "edit", supplier_name="空色"), case(2, "unknown", "edit", "again", total_amount=5), case(3, "unknown", "approve"),
        case(4, "twin", "approve"), case(5, "twin", "edit", partner_code="P-2007"), case(6, "twin", "approve"), case(7, "twin", "approve"),
        case(8, "limit", "reject", "no"), case(9, "limit", "approve", "yes after all"),
        case(10, "account", "approve"), case(11, "account", "approve", "called", "pay_printed"), case(12, "account", "reject"),
        case(13, "undated", "approve"), case(14, "undated", "edit", due_date=dt.date(2026, 3, 1)), case(15, "plain", "edit", total_amount=1), case(16, "nobody", "reject"),
        case(17, "empty", "retry"), case(18, None, "policy", "amount_review_threshold", "1"), case(19, None, "policy", "nothing", "1"), case(20, "near", "reject"), case(21, "near", "reject", "twice"),
    ]
    raw = intake.raw_records(spark.createDataFrame([(AT["empty"], json.dumps(invoice("港南運輸", "T-901", 20000)))], "arrival bigint, answer string"))[0]
    frame = spark.createDataFrame(events, CASES)
    cases = casework.apply_events(casework.open_cases(done["posted"], done["records"]), frame, done["master"], raw)
    log = {r.event_id: r for r in casework.log_of(cases).collect()}
    results = {
        1: "edited", 2: "edited", 3: "registered", 4: "blocked", 5: "edited", 6: "registered", 7: "already registered", 8: "rejected", 9: "registered", 10: "payment decision missing", 11: "registered",
        12: "already registered", 13: "cannot be sent: dates", 14: "edited", 15: "already registered", 16: "not found", 17: "read again", 18: "policy changed", 19: "no such dial", 20: "rejected", 21: "rejected",
    }
    assert {k: r.result for k, r in log.items()} == results
    assert log[3].event_note == "overrode 1 check(s): arithmetic.total" and log[11].event_note.startswith("called; payment details: supplier confirmed the printed account is correct")
    assert json.loads(log[2].before)["status"] == json.loads(log[1].after)["status"] == "EXTRACTED"
    assert json.loads(log[8].after)["status"] == "REJECTED" and json.loads(log[9].after)["status"] == "POSTED" and log[15].after is None
    rows = {r.arrival: r for r in cases.invoices().collect()}
    got = {name: rows[i].status for name, i in AT.items()}
    changed = {"unknown": "POSTED", "twin": "POSTED", "limit": "POSTED", "account": "POSTED", "undated": "NEEDS_REVIEW", "empty": "POSTED", "near": "REJECTED"}
    assert len(rows) == len(RAW) and got == dict(zip(AT, WANTED)) | changed
    assert rows[AT["twin"]].partner_code == "P-2007" and rows[AT["unknown"]].partner_code == "P-2005" and rows[AT["near"]].reason == "twice"
    numbers = sorted(r.accounting_id for r in rows.values() if r.accounting_id)
    assert numbers == [f"ACC-{i:04d}" for i in range(1, 12)] and cases.held.count() == 11
    assert "amount.threshold" in {c.name for c in rows[AT["undated"]].checks if not c.passed} and cases.policy["amount_review_threshold"] == 1


def test_policy(spark, done):
    assert policy.changed(POLICY, {"confidence_floor": 0.8}) is None
    with pytest.raises(ValueError):
        policy.changed(POLICY, {"duplicate_window_days": 400})
    moved = {(r.was, r.now): r.invoices for r in policy.what_if(done["checked"], POLICY, {"amount_review_threshold": 0}).collect()}
    # the first of two twins is blocked too once both are known; the one over the limit is free
    assert moved[("EXTRACTED", "BLOCKED")] == 1 and moved[("NEEDS_REVIEW", "EXTRACTED")] == 1


def test_a_grid_of_policies_is_each_of_them_judged(spark, done):
    points = policy.breakpoints(done["checked"], POLICY, done["master"])
    limits, floors, windows = (0, 60000, 300000, 5000000), (0.0, 0.8, 1.0), (0, 7)
    got = {}
    for r in policy.what_if_grid(points, limits, floors, windows).collect():
        got.setdefault((r.amount_review_threshold, r.confidence_floor, r.duplicate_window_days), {})[r.was, r.now] = r.invoices
    assert len(got) == 24
    for asked in ((60000, 0.8, 7), (0, 1.0, 0)):
        patch = dict(zip(("amount_review_threshold", "confidence_floor", "duplicate_window_days"), asked))
        assert got[asked] == {(r.was, r.now): r.invoices for r in policy.what_if(done["checked"], POLICY, patch, done["master"]).collect()}
    nothing = points.limit(0)
    assert policy.what_if_grid(nothing, limits, floors, windows).count() == 0


def test_near_counts_without_pairs(spark):
    """Against all pairs, with twins, blank numbers and nulls; and a total that one supplier repeats 20,000 times."""
    import datetime as dt

    draw, day = random.Random(3), dt.date(2026, 1, 1)
    pick = lambda *values: draw.choice(values)
    rows = [(i, pick("P-1", "P-2", None), pick("a", "A ", "b", "", None), pick(5, 6, None), pick(None, *[day + dt.timedelta(d) for d in range(0, 40, 3)])) for i in range(150)]
    schema = "arrival bigint, partner_code string, invoice_number string, total_amount bigint, issue_date date"
    frame = spark.createDataFrame(rows, schema)
    held = [(a, p, n, t, d and d + dt.timedelta(a % 3)) for a, p, n, t, d in rows[:100]]
    want, gaps = {}, {}
    for a, p, n, t, d in rows:
        key = (n or "").strip().upper()
        others = [(h, abs((h[4] - d).days)) for h in held if h[0] != a and None not in (p, t, d, h[4]) and h[1] == p and h[3] == t]
        want[a] = sum(far <= 7 and not (key and key == (h[2] or "").strip().upper()) for h, far in others)
        gaps[a] = min((far for _, far in others), default=None)
    existing = spark.createDataFrame(held, schema)
    assert {r.arrival: r.n_near for r in dedupe.near_counts(frame, existing).collect()} == {a: n for a, n in want.items() if n}
    assert {r.arrival: r.near_gap for r in dedupe.nearest_days(frame, existing).collect()} == {a: g for a, g in gaps.items() if g is not None}
    hot = spark.range(20000).select(F.col("id").alias("arrival"), F.lit("P-1").alias("partner_code"), F.concat(F.lit("n"), (F.col("id") / 2).cast("int")).alias("invoice_number"), F.lit(9).cast("bigint").alias("total_amount"), F.date_add(F.lit(day), (F.col("id") % 7).cast("int")).alias("issue_date"))
    counts = dedupe.near_counts(hot, hot)
    assert counts.count() == 20000 and counts.agg(F.min("n_near"), F.max("n_near")).first() == (19998, 19998)


def test_results_do_not_depend_on_partitions(spark, done):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    facts = done["checked"].drop("checks", "status", "reason", "dup_exact", "dup_near", "text_layer")
    got = {r.arrival: r.status for r in verify.judge(facts).select("arrival", "status").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {r.arrival: r.status for r in done["checked"].select("arrival", "status").collect()}
    assert checks.NAMES[0] == "extraction.lines_present"


def test_fuzzy_matches_are_those_of_all_pairs(spark):
    """Names that differ by characters added, lost, changed and swapped, against every pair's similarity."""
    from tallyweave.functions.udfs import common_length

    draw = random.Random(4)
    names = ["".join(draw.choice("abcde") for _ in range(draw.randint(1, 14))) for _ in range(60)] + ["customer%06d" % i for i in range(0, 90, 3)]
    asked = set()
    for n in names:
        for _ in range(draw.randint(0, 3)):
            i = draw.randrange(max(1, len(n)))
            n = draw.choice([n[:i] + n[i + 1 :], n[:i] + draw.choice("abcde") + n[i:], n[:i] + "z" + n[i + 1 :]])
        asked.add(n)
    asked -= {*names, ""}
    master = spark.createDataFrame([(f"P-{i}", n, [], "", i) for i, n in enumerate(names)], "partner_code string, name string, aliases array<string>, registration_no string, ord int")
    got = {r.name_key: (r.by_name, r.score) for r in partners.fuzzy_matches(spark.createDataFrame([(a,) for a in asked], "name_key string"), master).collect()}
    want = {}
    for a in asked:
        scores = [(-200.0 * common_length(a, n) / (len(a) + len(n)), i) for i, n in enumerate(names)]
        if -min(scores)[0] >= 85:
            want[a] = (f"P-{names.index(names[min(scores)[1]])}", round(-min(scores)[0], 1))
    assert got == want and len(want) > 30


def test_names_of_common_parts_and_long_names(spark):
    """Few pairs meet though every part of a name is in many others; results are those of all pairs."""
    from tallyweave.functions.udfs import common_length

    draw = random.Random(7)
    parts = ("北浜 青葉 みどり 白川 東西 大和 富士見 三条 日本 新町".split(), "電機 印刷 食品 運輸 石材 建設 精密 化学 製作所".split(), "工業 商事 サービス 販売 東日本 産業 研究所 エンジニアリング 西支店 流通センター".split())

    def altered(n, letters, changes):
        for _ in range(changes):
            i = draw.randrange(len(n) or 1)
            n = draw.choice([n[:i] + n[i + 1 :], n[:i] + draw.choice(letters) + n[i:], n[:i] + draw.choice(letters) + n[i + 1 :]])
        return n

    common = sorted({"".join(draw.choice(p) for p in parts) for _ in range(1500)})
    long = ["".join(draw.choice("abcdef") for _ in range(draw.randint(20, 40))) for _ in range(60)]
    for names, letters, most in ((common, "山川田", 2), (long, "abcdef", 7)):
        asked = sorted({altered(draw.choice(names), letters, draw.randint(1, most)) for _ in range(200)} - {*names, ""})
        master = spark.createDataFrame([(f"P-{i}", n, [], "", i) for i, n in enumerate(names)], "partner_code string, name string, aliases array<string>, registration_no string, ord int")
        frame = spark.createDataFrame([(a,) for a in asked], "name_key string")
        got = {r.name_key: (r.by_name, r.score) for r in partners.fuzzy_matches(frame, master).collect()}
        want = {}
        for a in asked:
            score, i = min((-200.0 * common_length(a, n) / (len(a) + len(n)), i) for i, n in enumerate(names))
            if -score >= 85:
                want[a] = (f"P-{i}", round(-score, 1))
        assert got == want and len(want) > 80
        if names is common:
            met = partners.segment_pairs(frame, partners.name_keys(master).select(F.col("name_key").alias("key")), 85).distinct().count()
            assert met < 0.02 * len(names) * len(asked)


def test_all_text_is_folded(spark):
    texts = ["ﾔﾏﾀﾞ商店", "㍿ヤマダ", "Ⅻ ﬁne", "plain", "１２３", "ｶﾞ㈱", None]
    rows = [(i, t, [(t, "①", "㌔", "５００", "②00", "１０％")]) for i, t in enumerate(texts)]
    raw = spark.createDataFrame(rows, "arrival bigint, supplier_name string, lines array<struct<description:string,quantity_raw:string,unit:string,unit_price_raw:string,amount_raw:string,tax_rate_raw:string>>")
    raw = raw.withColumns({c: F.lit("") for c in ("supplier_registration_no", "invoice_number", "issue_date_raw", "due_date_raw", "subtotal_raw", "tax_amount_raw", "total_amount_raw", "currency", "bank_details_raw", "notes")})
    raw = raw.withColumns({"tax_breakdown": F.array().cast("array<struct<rate_raw:string,base_raw:string,tax_raw:string>>"), "handwritten_annotations": F.array().cast("array<struct<text:string,location:string,affects_payment_details:boolean>>"), "field_confidence": F.struct(*[F.lit(1.0).alias(c) for c in ("supplier_name", "supplier_registration_no", "invoice_number", "issue_date", "due_date", "subtotal", "tax_amount", "total_amount", "lines")])})
    got = {r.arrival: r for r in normalize.normalize(raw).collect()}
    for i, t in enumerate(texts):
        folded = unicodedata.normalize("NFKC", t or "").strip()
        assert got[i].supplier_name == folded
        assert [(x.description, x.quantity, x.unit, x.amount, x.tax_code) for x in got[i].lines] == ([(folded, 1, "キロ", 200, "T10")] if folded else [])


def test_folding_is_nfkc_for_every_character_and_stays_in_the_jvm(spark):
    every = [(c, chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    every += [(-1, "か\u3099ﾊﾟe\u0301"), (-2, "𝟙㌶ㇷ゚"), (-3, ""), (-4, None)]
    frame = spark.createDataFrame(every, "c int, t string").repartition(8)
    got = frame.select("c", normalize.folded(F.col("t"), frame.schema["t"].dataType).alias("t")).collect()
    want = {c: t if t is None else unicodedata.normalize("NFKC", t) for c, t in every}
    # the native fold leaves plain texts to clean()
    plain = {r.c for r in frame.filter(F.col("t").rlike(S.FOLDABLE)).select("c").collect()}
    assert all(r.t == (want[r.c] if r.c not in plain else dict(every)[r.c]) for r in got) and len(plain) > 20_000
    wide = {r.c: r.t for r in frame.filter(F.col("t").rlike(S.FOLDABLE)).select("c", S.wide(F.col("t")).alias("t")).collect()}
    assert all(t == want[c] for c, t in wide.items())
    raw = spark.createDataFrame([(0, "x", [])], "arrival int, supplier_name string, lines array<struct<description:string>>")
    assert "Python" not in normalize.fold(raw)._jdf.queryExecution().toString()


def test_first_exact_duplicate(spark):
    """Groups of copies, against all pairs, in both scopes."""
    import datetime as dt

    rows = [(i, f"P-{i % 2}", "ab"[i % 3 > 0] + str(i % 2), 100 + i % 3, dt.date(2026, 1, 1 + i % 20)) for i in range(60)]
    frame = spark.createDataFrame(rows, "arrival bigint, partner_code string, invoice_number string, total_amount bigint, issue_date date")
    for scope in ("earlier", "all"):
        got = {r.arrival: (r.dup_exact, r.dup_near) for r in dedupe.find_duplicates(frame, frame, scope).collect()}
        for a in rows:
            others = [b for b in rows if b[0] != a[0] and b[1] == a[1] and (scope == "all" or b[0] < a[0])]
            first = min((b[0] for b in others if b[2] == a[2]), default=None)
            near = [b[0] for b in others if b[3] == a[3] and b[2] != a[2] and abs((b[4] - a[4]).days) <= 7 and (first is None or b[0] < first)]
            assert got.get(a[0], (None, [])) == (first, near)


def test_registration_by_keyed_state(spark, done, tmp_path):
    """Three deliveries as a stream; then the second batch is run again as after a loss between its two writes."""
    answers = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(RAW)], "arrival bigint, answer string")
    records, _ = intake.raw_records(answers)
    out = str(tmp_path)
    read = lambda name, *c: sorted(map(tuple, spark.read.parquet(f"{out}/{name}").select(*c).collect()))
    for low, high in ((0, 5), (5, 10), (10, 14)):
        records.filter(f"arrival >= {low} and arrival < {high}").write.mode("append").parquet(f"{out}/raw")
        stream = spark.readStream.schema(records.schema).parquet(f"{out}/raw")
        for query in arrivals.register_stream(stream, done["master"], out, POLICY):
            query.awaitTermination()
    assert [s for _, s in read("invoices", "arrival", "status")] == WANTED
    first = read("invoices", "arrival", "status", "accounting_id", "batch"), read("ledger", "accounting_id", "invoice_number", "bucket", "batch")
    assert [n for n, *_ in first[1]] == [f"ACC-{i:04d}" for i in range(1, 7)] and {r[3] for r in first[0]} == {0, 1, 2}
    facts = {r.arrival: (r.dup_exact, r.dup_near) for r in done["checked"].collect()}
    assert {r.arrival: (r.dup_exact, r.dup_near) for r in spark.read.parquet(f"{out}/invoices").collect()} == facts
    # the states that the second batch touched, as its checkpoint would give them once more
    again = keyed.states(spark.read.parquet(f"{out}/resolved").filter("batch <= 1").withColumnRenamed("batch", "part")).filter("what <> 'part' or value = '1'")
    shutil.rmtree(f"{out}/invoices/batch=1")
    arrivals.register_batch(again, 1, done["master"], out, POLICY)
    assert (read("invoices", "arrival", "status", "accounting_id", "batch"), read("ledger", "accounting_id", "invoice_number", "bucket", "batch")) == first


def test_admission_opens_touched_buckets_only(spark, done, tmp_path):
    held = spark.range(2000).select(F.format_string("P-%d", F.col("id") % 7 + 2001).alias("partner_code"), F.format_string("N-%d", "id").alias("invoice_number"))
    held.withColumn("bucket", ledger.bucket()).write.partitionBy("bucket").parquet(str(tmp_path / "held"))
    asked = held.filter("invoice_number in ('N-5', 'N-1900')")
    opened = ledger.touched(asked, spark.read.parquet(str(tmp_path / "held")))
    assert opened.count() < 60 and opened.join(asked, ledger.KEY).count() == 2
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_review_events(spark, done):
    events = [("limit", "approve", "ann", None, "ok", None), ("plain", "reject", "ann", None, None, None), ("unknown", "reject", "ann", None, "no", None), ("total", "edit", "bob", None, None, "B-9"), ("first", "edit", "bob", None, None, "x"), ("nobody", "reject", "bob", None, None, None), (None, "policy", "bob", None, "confidence_floor", None)]
    frame = spark.createDataFrame([(a and AT.get(a, 77), *rest) for a, *rest in events], "arrival bigint, kind string, actor string, outcome string, note string, patch_invoice_number string")
    got = {(r.arrival, r.kind): r.result for r in arrivals.judged_events(frame, done["posted"]).collect()}
    want = ["send", "already registered", "rejected", "edited", "already registered", "not found", "policy changed"]
    assert got == {(a and AT.get(a, 77), kind): w for (a, kind, *_), w in zip(events, want)}


def test_figures_move_with_the_state(spark, tmp_path):
    """Changes in three batches, a late one and a repeated one among them; the last batch is run again."""
    schema, out = "arrival bigint, version int, status string, cost_usd double, latency_ms int", str(tmp_path)
    batches = [
        [(1, 1, "PENDING", 0.5, None), (2, 1, "PENDING", 0.25, 0), (3, 1, "BLOCKED", 1.0, 40), (None, 1, "BLOCKED", 9.0, 9), (4, 1, "EXTRACTED", None, 10), (4, 1, "EXTRACTED", None, 10)],
        [(1, 2, "BLOCKED", 0.5, 30), (1, 3, "POSTED", 0.5, 20), (3, 3, "REJECTED", 1.0, 40), (5, 1, None, 0.0, 50)],
        [(3, 2, "POSTED", 7.0, 1), (2, 2, "POSTED", 0.5, 60), (4, 1, "EXTRACTED", None, 10)],
    ]
    for number, rows in [*enumerate(batches), (2, batches[2])]:
        figures.figures_batch(spark.createDataFrame(rows, schema), number, out)
        read = figures.figures(spark, out)
        got = {r.status: (r.invoices, r.cost_usd) for r in figures.by_status(read).collect()}
        want = [
            {"PENDING": (2, 0.75), "BLOCKED": (1, 1.0), "EXTRACTED": (1, 0.0)},
            {"PENDING": (1, 0.25), "POSTED": (1, 0.5), "REJECTED": (1, 1.0), "EXTRACTED": (1, 0.0), None: (1, 0.0)},
            {"POSTED": (2, 1.0), "REJECTED": (1, 1.0), "EXTRACTED": (1, 0.0), None: (1, 0.0)},
        ]
        assert got == want[number]
        assert figures.latency_median(read).first().latency_median == [40, 40, 40][number]
    figures.figures_batch(spark.createDataFrame([], schema), 3, out)
    assert figures.by_status(figures.figures(spark, out)).count() == 4
