"""Hand-sized cases with their expected results: the query computes them from the inputs, the SQL holds the expected rows as literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import money, names, texts
from tallyspark.operators import anomaly, identity
from tallyspark.operators.contracts import citations, clauses
from tallyspark.sources import bank_csv, payloads

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"CAST({value} AS DOUBLE)"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def values(columns: str, expected: list[tuple]) -> str:
    """The expected rows as SQL."""
    rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in expected)
    return f"SELECT {columns} FROM (VALUES {rows}) AS expected({columns})"


def golden(name: str, columns: str, expected: list[tuple]):
    """Register a function of the session under a name, with its rows as SQL."""

    def put(f):
        QUERIES[name] = lambda spark, folder: f(spark)
        ORACLES[name] = values(columns, expected)
        return f

    return put


# Narrations as banks write them, with the party that each names.
NARRATIONS = [
    ("NEFT CR GLOBAL PAY SERVICES A/C CRESTVIEW RETAIL", "GLOBAL PAY SERVICES"), ("NEFT CR GLOBAL PAY SERVICES A/C PINNACLE FOODS", "GLOBAL PAY SERVICES"),
    ("RTGS CR APEX FOUNDER HOLDINGS PVT LTD ADVANCE", "APEX FOUNDER HOLDINGS PVT LTD"), ("RTGS DR APEX FOUNDER HOLDINGS PVT LTD ADVISORY FEE", "APEX FOUNDER HOLDINGS PVT LTD"),
    ("RTGS CR APEX FOUNDER HOLDINGS INTERCOMPANY", "APEX FOUNDER HOLDINGS"), ("RTGS DR APEX FOUNDER HOLDINGS INTERCOMPANY REVERSAL", "APEX FOUNDER HOLDINGS"),
    ("CHARGEBACK DEBIT HALCYON HEALTH", "HALCYON HEALTH"), ("RAZORPAY REFUND COBALT MEDIA NETWORKS", "COBALT MEDIA NETWORKS"), ("RAZORPAY SETTLEMENT COBALT MEDIA", "COBALT MEDIA"),
    ("RAZORPAY REFUND QUANTUM RETAIL PARTIAL", "QUANTUM RETAIL"), ("NEFT CR MERIDIAN HOLDINGS PVT LTD REF INV-2026-120", "MERIDIAN HOLDINGS PVT LTD"),
    ("NEFT CR SILVERLINE EDU PVT LTD INV090 091 092 093", "SILVERLINE EDU PVT LTD"), ("RAZORPAY SETTLEMENT NORTHSTAR TECH M1", "NORTHSTAR TECH"),
    ("NEFT CR COBBLE INDUSTRIES INSTALMENT 1", "COBBLE INDUSTRIES"), ("NEFT CR IRONBRIDGE MFG INSTALLMENT 2", "IRONBRIDGE MFG"), ("NEFT CR ATLAS WORKS TRANCHE 2", "ATLAS WORKS"),
    ("NEFT CR ATLAS WORKS MILESTONE 3", "ATLAS WORKS"), ("NEFT CR TRANCHE CAPITAL LLP", "TRANCHE CAPITAL LLP"), ("NEFT CR MILESTONE SYSTEMS", "MILESTONE SYSTEMS"),
    ("NEFT CR ACME INDUSTRIES PVT LTD", "ACME INDUSTRIES PVT LTD"), ("NEFT CR ACCENTURE SOLUTIONS", "ACCENTURE SOLUTIONS"), ("NEFT CR REFINERY CORP", "REFINERY CORP"),
    ("NEFT CR UTRECHT TRADING", "UTRECHT TRADING"), ("NEFT CR ADVANCE AUTO PARTS LTD", "ADVANCE AUTO PARTS LTD"), ("TRF FROM A/C 998877 JOHN DOE", "JOHN DOE"),
    ("NEFT CR BLUE HARBOUR LOGISTICS LLP", "BLUE HARBOUR LOGISTICS LLP"), ("NEFT CR BLUE HARBOR M1", "BLUE HARBOR"), ("NEFT CR-APEX INDUSTRIES FY2026", "APEX INDUSTRIES"),
    ("NEFT CR-APEX INDUSTRIES 2026-27", "APEX INDUSTRIES"), ("   ", None), (None, None),
]


@golden("prj10_narration_cases", "n, party", [(i, p) for i, (_, p) in enumerate(NARRATIONS)])
def prj10(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NARRATIONS)], "n int, narration string")
    return rows.select("n", texts.counterparty(F.col("narration")).alias("party"))


WORDING = [("a fraudster stole it", True), ("Deceit, plainly", True), ("laundered money", True), ("an embezzlement", True), ("fraudulent invoice", True), ("defrauded", False), ("guilty of a crime", False), ("scammed", False), ("a scam", True), ("criminals", False), ("theft", True), ("illegal", True)]


@golden("flt7_wording_cases", "n, accuses", [(i, a) for i, (_, a) in enumerate(WORDING)])
def flt7(spark):
    return spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WORDING)], "n int, t string").select("n", F.col("t").rlike(texts.ACCUSATORY).alias("accuses"))


@golden("prj15_cell_cases", "n, cell", [(0, "-.5"), (1, "'=1+2"), (2, "-225000.00"), (3, "'@cmd"), (4, "1,200"), (5, "'+x"), (6, "plain"), (7, "+7"), (8, ""), (9, "'-1-2")])
def prj15(spark):
    cells = ["-.5", "=1+2", " -225000.00", "@cmd", "1,200 ", "\t+x", " plain", "+7", None, "-1-2"]
    return spark.createDataFrame(list(enumerate(cells)), "n int, t string").select("n", texts.csv_cell(F.col("t")).alias("cell"))


@golden("prj14_feed_date_cases", "n, day", [(0, "2026-04-05"), (1, "2026-04-05"), (2, "2026-04-05"), (3, "2026-04-25"), (4, "2026-04-05"), (5, "2026-04-05"), (6, "2026-04-05"), (7, None), (8, None), (9, "2026-04-05"), (10, None)])
def prj14(spark):
    said = ["2026-04-05", "05/04/2026", "05-04-2026", "04/25/2026", "5 Apr 2026", "2026/04/05", "2026-04-05T10:00:00Z", "05/04/26", "0000-00-00", " 5/4/2026 ", "31/02/2026"]
    return spark.createDataFrame(list(enumerate(said)), "n int, t string").select("n", bank_csv.feed_date(F.col("t")).cast("string").alias("day"))


@golden("prj4_invoice_cases", "source_id, status, description, quantity, hint", [
    ("a", "sent", "Setup", 1, "one_time"), ("b", "unknown", "", 1, "unknown"), ("c", "partially_paid", "Annual licence", 3, "recurring"), ("d", "sent", "Training", 1, "one_time"),
])
def prj4(spark):
    rows = [
        '{"invoice_id": "a", "status": "viewed", "line_items": [{"name": "Setup", "description": " "}]}', '{"invoice_id": "b", "status": "open", "line_items": [{}]}',
        '{"invoice_id": "c", "status": "Paid", "balance": 1.5, "line_items": [{"description": "Annual licence", "quantity": 3}]}',
        '{"invoice_id": "d", "status": "unpaid", "line_items": [{"description": "Training", "quantity": 0}]}',
    ]
    got = payloads.invoices(spark.createDataFrame([(r,) for r in rows], "payload string"))
    line = F.get("line_items", F.lit(0))
    return got.select("source_id", "status", line["description"].alias("description"), line["quantity"].cast("int").alias("quantity"), line["hint"].alias("hint"))


PAGES = [(1, "The monthly fee is INR 5,00,000\n(five lakh), payable in advance."), (2, "This Agreement commences on 1 April 2026."), (3, "Governed by the laws of India.")]
QUOTES = [  # field, value, page, quote: note, verified, page
    ("genuine", "500000", 1, "INR 5,00,000 five lakh payable", "verified", True, 1), ("fabricated", "x", 1, "free of any charge", "not_found", False, 1),
    ("moved", "2026-04-01", 1, "commences on 1 april 2026", "other_page", True, 2), ("short", "INR", 1, "INR", "verified", True, 1), ("vague", "100", 1, "fee", "too_short", False, 1),
    ("roams", "India", 1, "India", "short_not_on_page", False, 1), ("letter", "a", 1, "a", "too_short", False, 1),
]


@golden("str11_citation_cases", "field, note, verified, page", [(f, note, ok, page) for f, _, _, _, note, ok, page in QUOTES])
def str11(spark):
    pages = spark.createDataFrame([(1, n, t) for n, t in PAGES], "contract_id int, page int, text string")
    cited = spark.createDataFrame([(1, *q[:4]) for q in QUOTES] + [(1, "none", "x", None, "y"), (1, "empty", "x", 1, "")], "contract_id int, field string, value string, page int, quote string")
    return citations(cited, pages).select("field", "note", "verified", "page")


QUESTIONS = [
    ("ambiguous_match", "BLUE HARBOUR LOGISTICS LLP ↔ Blue Harbor", None, None, "ambiguous_match|blue harbor|blue harbour logistics"),
    ("ambiguous_match", "BLUE HARBOR ↔ Blue Harbour Logistics", None, None, "ambiguous_match|blue harbor|blue harbour logistics"),
    ("ambiguous_match", "IRONBRIDGE MFG INSTALMENT 1 ↔ IRONBRIDGE MFG H2", None, None, "ambiguous_match|ironbridge mfg|ironbridge mfg instal"),
    ("critic_dispute", "Withheld: INV-77", ["WRONG_PERIOD", "DOUBLE_COUNTED"], None, "critic_dispute|DOUBLE_COUNTED+WRONG_PERIOD"),
    ("anomaly", "Two payments within a day", None, "A01_CLOSE_REPEAT", "anomaly|A01_CLOSE_REPEAT"),
    ("missing_bank", "Is this receipt confirmed: invoice INV-2026/7", None, None, "missing_bank|is this receipt confirmed"),
    ("other", None, None, None, "other|"),
]


@golden("str16_question_cases", "n, key", [(i, q[4]) for i, q in enumerate(QUESTIONS)])
def str16(spark):
    rows = spark.createDataFrame([(i, *q[:4]) for i, q in enumerate(QUESTIONS)], "n int, category string, title string, codes array<string>, rule string")
    return rows.select("n", texts.question_key(F.col("category"), F.col("title"), F.col("codes"), F.col("rule")).alias("key"))


FILES = [
    ("Northstar_Subscription_FY2025.pdf", "Northstar"), ("Blue_Harbor_Analytics_Agreement.pdf", "Blue Harbor Analytics"), ("Cobalt-Media_MSA_2.docx", "Cobalt Media"),
    ("Quantum_Retail_SOW_2026_Scanned.pdf", "Quantum Retail"), ("Plain", "Plain"),
]


@golden("str17_file_cases", "n, name", [(i, n) for i, (_, n) in enumerate(FILES)])
def str17(spark):
    return spark.createDataFrame([(i, f) for i, (f, _) in enumerate(FILES)], "n int, f string").select("n", names.name_from_filename(F.col("f")).alias("name"))


RECORD = "ws int, id int, source string, name string, email string, phone string, tax_id string, address string, platform_id string"
PEOPLE = [
    (1, 1, "a", "Alpha One", None, None, "27ABCDE1234F1Z5", None, None), (1, 2, "a", "Alfa Uno", None, None, "29ABCDE1234F1Z9", None, None),
    (1, 3, "a", "Beta", None, None, "BAD-1", None, "p1"), (1, 4, "b", "Beta Two", None, None, "bad1", None, "p1"), (1, 5, "a", "Gamma", None, None, None, None, "p1"), (1, 6, "a", "Delta", None, None, None, None, "p9"),
    (1, 7, "a", "Echo", "x@firm.example", None, None, None, None), (1, 8, "a", "Foxtrot", "X+b@firm.example", None, None, None, None), (1, 9, "a", "Echo Works", "y@firm.example", None, None, None, None),
    (1, 10, "a", "Golf", "g@gmail.com", None, None, None, None), (1, 11, "a", "Hotel", "g@gmail.com", None, None, None, None),
    (1, 12, "a", "Meridian Holdings", "m@group.example", None, "27ABCDE9999F1Z5", None, None), (1, 13, "a", "Meridian Systems", "s@group.example", None, "27ZZZZZ9999F1Z5", None, None),
]
EXACT = [(1, 2, 0.99), (3, 4, 0.98), (3, 5, 0.97), (7, 8, 0.94), (7, 9, 0.92), (10, 11, None), (12, 13, None), (5, 6, None)]


@golden("idn1_rule_cases", "l, r, exact", EXACT)
def idn1(spark):
    recs = identity.records(spark.createDataFrame(PEOPLE, RECORD))
    pairs = spark.createDataFrame([(1, l, r) for l, r, _ in EXACT], "ws int, l int, r int")
    return identity._sides(pairs, recs).select("l", "r", identity.exact_match().cast("decimal(3,2)").alias("exact"))


CRITIC = [  # l, r, weight, exact, conflict, decision: objections, verdict, decision
    (12, 13, 9.0, None, True, "ACCEPTED", "CONTRADICTORY_IDENTIFIER: tax", "DISPUTE", "REVIEW"), (1, 2, 20.0, 0.99, False, "ACCEPTED", "", "AGREE", "ACCEPTED"),
    (7, 12, 8.0, None, True, "ACCEPTED", "CONTRADICTORY_IDENTIFIER: domain", "DISPUTE", "REVIEW"), (5, 6, 7.0, None, False, "ACCEPTED", "", "NEEDS_REVIEW", "REVIEW"),
    (5, 10, 12.0, None, False, "ACCEPTED", "", "AGREE", "ACCEPTED"), (7, 13, -4.0, None, True, "REJECTED", "CONTRADICTORY_IDENTIFIER: domain", "AGREE", "REJECTED"),
    (20, 21, 11.0, None, False, "ACCEPTED", "SHARED_ADDRESS_NOT_SAME", "DISPUTE", "REVIEW"), (20, 22, 2.0, None, False, "REVIEW", "", "AGREE", "REVIEW"),
]


@golden("idn9_critic_cases", "l, r, objections, verdict, decision", [(c[0], c[1], *c[6:]) for c in CRITIC])
def idn9(spark):
    shared = [(1, 20, "a", "Kilo", None, None, None, "9 MG Road 560001", None), (1, 21, "a", "Lima", None, None, None, "9, MG Rd 560001", None), (1, 22, "a", "Kilo Two", None, None, None, None, None)]
    pairs = spark.createDataFrame([(1, *c[:6]) for c in CRITIC], "ws int, l int, r int, weight double, exact double, conflict boolean, decision string")
    got = identity.criticised(pairs, identity.records(spark.createDataFrame(PEOPLE + shared, RECORD)))
    return got.select("l", "r", F.array_join("objections", ",").alias("objections"), "verdict", "decision")


@golden("idn6_collected_records", "id, name", [
    ("contact:c1", "Acme Pvt Ltd"), ("contact:c2", "c2"), ("crm:h1", "Acme"), ("contract:1", "Zenith Ltd"), ("contract:3", "Northstar"), ("payment:10", "Zenith"), ("bank:20", "ACME"), ("bank:22", "ZENITH"),
])
def idn6(spark):
    contacts = spark.createDataFrame([(1, "c1", None, "Acme Pvt Ltd", "a@acme.example", None, "27ABCDE1234F1Z5", None, None), (1, "c2", " ", None, None, None, None, None, None)], "ws int, source_id string, contact_name string, company_name string, email string, phone string, gst_no string, address string, website string")
    crm = spark.createDataFrame([(1, "h1", "Acme", "acme.example", "Pune"), (1, "h2", None, "x.example", None)], "ws int, source_id string, name string, domain string, city string")
    contracts = spark.createDataFrame([(1, 1, "a.pdf", "Zenith Ltd", True), (1, 2, "Unread_Agreement.pdf", None, False), (1, 3, "Northstar_Subscription_FY2025.pdf", None, True)], "ws int, contract_id int, document_name string, customer_name string, terms_read boolean")
    payments = spark.createDataFrame([(1, 10, "p1", "Zenith", None, None), (1, 11, "p2", "ZENITH", None, None), (1, 12, "p3", None, None, None)], "ws int, payment_id int, source_id string, customer_name string, email string, phone string")
    bank = spark.createDataFrame([(1, 20, "b1", "ACME", "credit"), (1, 21, "b2", "Payroll", "debit"), (1, 22, "b3", "ZENITH", "debit"), (1, 23, "b4", "acme", "debit")], "ws int, bank_id int, source_id string, counterparty string, direction string")
    return identity.collected(contacts, crm, contracts, payments, bank).select("id", "name")


@golden("idn8_applied_clusters", "entity_id, name, aliases, tax_ids, moved_from", [
    ("e1", "Larkspur Systems Pvt Ltd", "LARKSPUR SYSTEM LTD,Larkspur Systems Pvt Ltd", "27ABCDE1234F1Z5", "e2"), ("e4", "Kept By Hand", "", "", ""), ("e5", "Meridian Systems", "", "27ZZZZZ9999F1Z5", ""),
    ("new:m1", "Meridian Holdings Ltd", "Meridian Holdings Ltd,Meridian Systems", "27ABCDE9999F1Z5", ""),
])
def idn8(spark):
    recs = identity.records(spark.createDataFrame(
        [(1, "l1", "a", "Larkspur Systems Pvt Ltd", None, None, "27ABCDE1234F1Z5", None, None), (1, "l2", "a", "LARKSPUR SYSTEM LTD", None, None, None, None, None), (1, "m1", "a", "Meridian Holdings Ltd", None, None, "27ABCDE9999F1Z5", None, None), (1, "m2", "a", "Meridian Systems", None, None, None, None, None)],
        RECORD.replace("id int", "id string"),
    ))
    found = spark.createDataFrame([(1, "l1", "l1"), (1, "l2", "l1"), (1, "m1", "m1"), (1, "m2", "m1")], "ws int, id string, cluster string")
    none = []
    entities = spark.createDataFrame(
        [(1, "e1", "larkspur systems", "larkspur systems", none, none, none, False, 2), (1, "e2", "LARKSPUR SYSTEM LTD", "larkspur system", none, none, none, False, 1), (1, "e3", "Nobody", "nobody", none, none, none, False, 1),
         (1, "e4", "Kept By Hand", "kept by hand", none, none, none, True, 1), (1, "e5", "Meridian Systems", "meridian systems", none, none, ["27ZZZZZ9999F1Z5"], False, 1)],
        "ws int, entity_id string, name string, normalized_name string, aliases array<string>, domains array<string>, tax_ids array<string>, human_confirmed boolean, created_at int",
    )
    owned = spark.createDataFrame([(1, "e2"), (1, "e5")], "ws int, entity_id string")
    after, moves = identity.applied(recs, found, entities, owned)
    came = moves.groupBy("ws", F.col("to_id").alias("entity_id")).agg(F.array_join(F.array_sort(F.collect_list("from_id")), ",").alias("moved_from"))
    return after.join(came, ["ws", "entity_id"], "left").select("entity_id", "name", F.array_join("aliases", ",").alias("aliases"), F.array_join("tax_ids", ",").alias("tax_ids"), F.coalesce("moved_from", F.lit("")).alias("moved_from"))


@golden("jsn1_canonical_json", "n, canonical", [(0, '{"a":{"c":[1,"x"],"d":null},"b":1}'), (1, "[]"), (2, None)])
def jsn1(spark):
    return spark.createDataFrame([(0, '{"b": 1, "a": {"d": null, "c": [1, "x"]}}'), (1, " [ ] "), (2, "{not json")], "n int, t string").select("n", texts.canonical_json(F.col("t")).alias("canonical"))


@golden("prj18_redaction", "n, shown", [(0, '{"a":[{"CVV":"<redacted>","x":1}],"card":"<redacted>","name":"n"}'), (1, None), (2, None)])
def prj18(spark):
    return spark.createDataFrame([(0, '{"name": "n", "card": {"number": 1}, "a": [{"CVV": "123", "x": 1}]}'), (1, "{"), (2, None)], "n int, t string").select("n", texts.redacted("t").alias("shown"))


@golden("str19_slugs", "n, slug", [(0, "northstar-tech-2026"), (1, "workspace"), (2, "workspace"), (3, "été")])
def str19(spark):
    return spark.createDataFrame([(0, " Northstar & Tech/2026!"), (1, None), (2, "--"), (3, "Été")], "n int, t string").select("n", texts.slug(F.col("t")).alias("slug"))


@golden("agg1_mixed_currencies", "k, total, error", [(1, 30, None), (2, None, "cannot sum EUR, USD into a INR total")])
def agg1(spark):
    rows = spark.createDataFrame([(1, 10, "INR"), (1, 20, "INR"), (2, 5, "INR"), (2, 5, "USD"), (2, 1, "EUR")], "k int, amount long, currency string")
    return money.currency_sums(rows, ["k"], "amount", "currency", F.lit("INR"))


PAIR = "ws int, l int, r int, weight double, conflict boolean, decision string"
PAIRS = [(1, 1, 2, 8.0, False, "ACCEPTED"), (1, 2, 3, 7.0, False, "ACCEPTED"), (1, 1, 3, -9.0, True, "REJECTED"), (1, 4, 5, 2.0, True, "REVIEW"), (1, 5, 6, 9.0, True, "ACCEPTED"), (1, 7, 8, 20.0, False, "ACCEPTED")]


@golden("idn3_cannot_link_cases", "l, r", [(1, 3), (4, 5)])
def idn3(spark):
    return identity.cannot_link(spark.createDataFrame(PAIRS, PAIR)).select("l", "r")


@golden("idn4_cluster_cases", "id, cluster", [(1, 1), (2, 1), (3, 3), (5, 5), (6, 5), (7, 7), (8, 7)])
def idn4(spark):
    """1 and 3 may not meet through 2: the stronger of its links wins."""
    return identity.clusters(spark.createDataFrame(PAIRS, PAIR)).select("id", "cluster")


@golden("idn5_conflict_cases", "l, r, cluster", [(1, 3, 1)])
def idn5(spark):
    """Clusters from elsewhere that hold a pair which was rejected by a contradiction."""
    found = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 4), (1, 5, 5)], "ws int, id int, cluster int")
    return identity.transitivity_conflicts(spark.createDataFrame(PAIRS, PAIR), found).select("l", "r", "cluster")


@golden("idn7_memory_cases", "l, r, decision", [(1, 2, "REJECTED"), (2, 3, "ACCEPTED"), (1, 3, "REJECTED"), (4, 5, "ACCEPTED"), (5, 6, "ACCEPTED"), (7, 8, "ACCEPTED")])
def idn7(spark):
    memory = spark.createDataFrame([(1, 2, 1, "REJECTED"), (1, 4, 5, "ACCEPTED"), (2, 7, 8, "REJECTED")], "ws int, a int, b int, verdict string")
    return identity.overridden(spark.createDataFrame(PAIRS, PAIR), memory).select("l", "r", "decision")


@golden("jn13_debit_cases", "debit_id, refund_id", [(1, 10), (2, 11), (4, 13)])
def jn13(spark):
    debits = spark.createDataFrame([(1, 1, 500, "2024-01-01"), (1, 2, 500, "2024-01-02"), (1, 3, 500, "2024-01-03"), (1, 4, 700, "2024-03-01"), (1, 5, 900, "2024-03-01")], "ws int, debit_id long, amount long, booked_on string")
    refunds = spark.createDataFrame([(1, 10, 500, "2024-01-02"), (1, 11, 500, "2024-01-08"), (1, 12, 500, "2024-02-20"), (1, 13, 700, None), (1, 14, 900, "2024-03-09")], "ws int, refund_id long, amount long, refunded_on string")
    day = lambda rows, c: rows.withColumn(c, F.to_date(c))
    return anomaly.matched_debits(day(debits, "booked_on"), day(refunds, "refunded_on")).select("debit_id", "refund_id")


CONTRACT = "1. FEES\nThe fee is payable quarterly in advance.\n2. TERM\nThe term begins on the effective date.\nok\n3. X\ny"


@golden("str14_clause_cases", "n, heading, start, stop", [(0, "1. FEES", 0, 48), (1, "2. TERM", 49, 98)])
def str14(spark):
    """The last passage is too short to be a clause."""
    pages = spark.createDataFrame([(1, 1, CONTRACT), (2, 1, None), (3, 1, "  ")], "doc_id int, page int, text string")
    return clauses(pages).select("n", "heading", "start", "stop")
