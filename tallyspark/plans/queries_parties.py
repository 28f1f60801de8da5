"""Queries over names, identity, anomalies, graphs, versions, reviews and texts, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import money, names, similarity, texts
from ..operators import anomaly, contracts, graph, identity, quality, reconcile, review, semantic
from ..sources.shared import staged
from .adapters import PERIOD, Tables, oracle, p0, p1

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
P1 = f"DATE '{PERIOD[1]}'"


def query(name: str, sql: str | None = None, *ctes: str):
    """Register a function of Tables under a name, with the SQL of its result."""

    def put(f):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[name] = oracle(sql, *ctes)
        return f

    return put


# --- names and identifiers ---------------------------------------------------------------------------------------------------------------

NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[.,''"()\[\]]', ' ', 'g'), '\b(private\s+limited|pvt\.?\s*ltd\.?|pvt\.?|p\.?\s*ltd\.?|public\s+limited|limited|ltd\.?|llp|llc|inc\.?|incorporated|corp\.?|corporation|company|co\.?|gmbh|enterprises|ventures)\b\.?', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"""


@query("str1_normalize_name", f"SELECT customer_id, {NORM.format('name')} AS key FROM customers")
def str1(t):
    return t.customers().select("customer_id", names.normalize_name(F.col("name")).alias("key"))


@query("str2_name_tokens", f"SELECT customer_id, array_to_string(list_sort(list_distinct(list_filter(string_split({NORM.format('name')}, ' '), lambda x: length(x) > 1))), ' ') AS tokens FROM customers")
def str2(t):
    return t.customers().select("customer_id", F.array_join(names.name_tokens(F.col("name")), " ").alias("tokens"))


@query("str3_domains", """
SELECT page_id, CASE WHEN contains(h, '.') AND h NOT IN ('gmail.com', 'yahoo.com') THEN h END AS domain FROM (
 SELECT page_id, regexp_extract(regexp_replace(regexp_replace(lower(CASE WHEN page_id % 5 = 0 THEN 'Someone@GMAIL.com' ELSE url END), '^https?://', ''), '^www[.]', ''), '[^@/:]*$|^[^@/:]*') AS h0,
        regexp_extract(regexp_replace(regexp_replace(lower(CASE WHEN page_id % 5 = 0 THEN 'gmail.com' ELSE url END), '^https?://', ''), '^www[.]', ''), '^[^/:]*') AS h FROM pages)""")
def str3(t):
    p = t.raw("pages")
    return p.select("page_id", names.normalize_domain(F.when(F.col("page_id") % 5 == 0, "Someone@GMAIL.com").otherwise(F.col("url"))).alias("domain"))


@query("str4_emails", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'u' || user_id || '@gmail.com' WHEN 1 THEN 'u.' || user_id || '@firm.example' WHEN 2 THEN NULL ELSE 'x' || user_id || '@googlemail.com' END AS email FROM events""")
def str4(t):
    e, u = t.raw("events"), F.col("user_id").cast("string")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("U."), u, F.lit("+tag@Gmail.com"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit(" u."), u, F.lit("+a+b@firm.example"))).when(F.col("event_id") % 4 == 2, F.lit("nobody")).otherwise(F.concat(F.lit("x"), u, F.lit("@googlemail.com")))
    return e.select("event_id", names.normalize_email(raw).alias("email"))


@query("str5_phones", "SELECT customer_id, CASE WHEN customer_id % 3 = 0 THEN NULL ELSE lpad(CAST(customer_id AS VARCHAR), 10, '9') END AS phone FROM customers")
def str5(t):
    k = F.lpad(F.col("customer_id").cast("string"), 10, "9")
    raw = F.when(F.col("customer_id") % 3 == 0, "12-34").when(F.col("customer_id") % 3 == 1, F.concat(F.lit("+91 "), F.substring(k, 1, 5), F.lit("-"), F.substring(k, 6, 5))).otherwise(F.concat(F.lit("0"), k))
    return t.customers().select("customer_id", names.normalize_phone(raw).alias("phone"))


@query("str6_tax_ids", "SELECT customer_id, CASE WHEN customer_id % 2 = 0 THEN 'ABCDE' || lpad(CAST(customer_id % 10000 AS VARCHAR), 4, '0') || 'F' END AS pan, CASE WHEN customer_id % 2 = 0 THEN '27ABCDE' || lpad(CAST(customer_id % 10000 AS VARCHAR), 4, '0') || 'F1Z5' ELSE 'BAD' || customer_id END AS tax_id FROM customers")
def str6(t):
    k = F.lpad((F.col("customer_id") % 10000).cast("string"), 4, "0")
    raw = F.when(F.col("customer_id") % 2 == 0, F.concat(F.lit("27-abcde"), k, F.lit("f 1z5"))).otherwise(F.concat(F.lit("bad/"), F.col("customer_id").cast("string")))
    return t.customers().select("customer_id", names.pan_of(raw).alias("pan"), names.normalize_tax_id(raw).alias("tax_id"))


@query("str7_addresses", "SELECT customer_id, (customer_id % 90) || ' mg rd 2nd flr nr blk ' || segment_ || ' ' || (560000 + customer_id % 100) AS address, CAST(560000 + customer_id % 100 AS VARCHAR) AS pin FROM (SELECT *, replace(lower(segment), 'building', 'bldg') AS segment_ FROM customers)")
def str7(t):
    raw = F.concat((F.col("customer_id") % 90).cast("string"), F.lit(", M.G. Road; 2nd Floor (near Block "), F.col("segment"), F.lit(") - "), (F.col("customer_id") % 100 + 560000).cast("string"))
    raw = F.regexp_replace(raw, r"M\.G\.", "MG")
    return t.customers().select("customer_id", names.normalize_address(raw).alias("address"), names.postal_code(raw).alias("pin"))


@query("str8_ngrams", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(generate_series(1, greatest(length(n) - 3, 1)), lambda i: substring(n, CAST(i AS INTEGER), 4)))), ',') AS grams FROM (SELECT p_partkey, replace(p_name, ' ', '') AS n FROM part)")
def str8(t):
    return t.raw("part").select("p_partkey", F.array_join(F.array_sort(names.ngrams(F.col("p_name"))), ",").alias("grams"))


@query("str9_str10_name_similarity")
def str9(t):
    n = t.raw("part").select("p_name").distinct()
    pairs = n.select(F.col("p_name").alias("a"), F.split("p_name", " ")[0].alias("w")).join(n.select(F.col("p_name").alias("b"), F.split("p_name", " ")[0].alias("w")), "w").where("a < b")
    return pairs.select("a", "b", similarity.name_similarity("a", "b").alias("ratio"), similarity.name_containment("a", "b").alias("partial"))


@query("str12_str13_amounts", """
SELECT invoice_id, CASE invoice_id % 4 WHEN 0 THEN (total % 900 + 1) * 10000000 * 100 WHEN 1 THEN (total % 90 + 1) * 100000 * 100 + 50000 * 100 WHEN 2 THEN total - total % 100 ELSE NULL END AS minor, ['monthly', 'annual', 'unknown', 'half_yearly'][invoice_id % 4 + 1] AS frequency FROM invoices""")
def str12(t):
    k = F.col("invoice_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("INR "), (F.col("total") % 900 + 1).cast("string"), F.lit(" crore"))).when(k == 1, F.concat((F.col("total") % 90 + 1).cast("string"), F.lit(".5 Lakh only"))).when(k == 2, F.concat(F.lit("Rs "), F.format_number(F.floor(F.col("total") / 100), 0))).otherwise("nil")
    frequency = F.element_at(F.array(*map(F.lit, ("Per Month", "annually", "weekly", "semi-annual"))), (k + 1).cast("int"))
    return t.invoices().select("invoice_id", texts.parse_amount(raw).alias("minor"), texts.parse_frequency(frequency).alias("frequency"))


@query("dt6_dates", "SELECT invoice_id, CASE WHEN invoice_id % 5 = 4 THEN NULL ELSE issue_date END AS parsed FROM invoices")
def dt6(t):
    d, k = F.col("issue_date"), F.col("invoice_id") % 5
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "d MMMM yyyy")).when(k == 2, F.date_format(d, "dd/MM/yyyy")).when(k == 3, F.concat(F.lit("dated "), F.date_format(d, "yyyy-MM-dd"), F.lit(" or so"))).otherwise("31/02/2001")
    return t.invoices().select("invoice_id", texts.parse_date(raw).alias("parsed"))


@query("prj10_counterparties", """
SELECT bank_id, CASE WHEN counterparty IS NULL THEN 'ACME INDUSTRIES' ELSE counterparty END AS party FROM bank""")
def prj10(t):
    k, party = F.col("bank_id") % 4, F.coalesce("counterparty", F.lit("ACME INDUSTRIES"))
    raw = F.when(k == 0, F.concat(F.lit("NEFT CR-"), party, F.lit(" INV-123 124"))).when(k == 1, F.concat(F.lit("UPI/"), party, F.lit(" REF: 99X7 ADVISORY FEE"))).when(k == 2, F.concat(F.lit("TRF FROM A/C 998877 "), party)).otherwise(F.concat(F.lit("RTGS razorpay settlement refund "), party, F.lit(" INSTALMENT 2")))
    return t.bank().select("bank_id", texts.counterparty(raw).alias("party"))


@query("str16_question_keys", "SELECT ws, key, count(*) AS n FROM (SELECT ws, 'ambiguous_match|alpha k' || least(customer_id % 7, customer_id % 5) || 'x|alpha k' || greatest(customer_id % 7, customer_id % 5) || 'x' AS key FROM customers) GROUP BY ALL")
def str16(t):
    """The two names of a match in either order, each with a record's number behind it."""
    name = lambda n: F.concat(F.lit("Alpha K"), (F.col("customer_id") % n).cast("string"), F.lit("x Ltd INV-"), F.col("customer_id").cast("string"))
    key = texts.question_key(F.lit("ambiguous_match"), F.concat(name(7), F.lit(" ↔ "), name(5)), F.array().cast("array<string>"), F.lit(""))
    return t.customers().groupBy("ws", key.alias("key")).agg(F.count("*").alias("n"))


@query("str17_names_of_files", "SELECT customer_id, 'Firm K' || customer_id AS name FROM customers")
def str17(t):
    f = F.concat(F.lit("Firm_K"), F.col("customer_id").cast("string"), F.lit("_Agreement_2024_FY2025.pdf"))
    return t.customers().select("customer_id", names.name_from_filename(f).alias("name"))


@query("str18_hashes", "SELECT doc_id, sha256(text) AS h FROM documents")
def str18(t):
    return t.raw("documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query("flt7_accusatory_wording", r"SELECT doc_id FROM (SELECT doc_id, text || [' This is Fraud.', ' defrauded', ' criminals', ' he stole it', ' guilty of a crime', ' DECEIT'][doc_id % 6 + 1] AS n FROM documents) WHERE regexp_matches(n, '(?i)\b(fraud|fraudulent|fraudster|criminal|illegal|launder\w*|embezzl\w*|theft|stole|scam|deceit)\b')")
def flt7(t):
    tails = F.array(*map(F.lit, (" This is Fraud.", " defrauded", " criminals", " he stole it", " guilty of a crime", " DECEIT")))
    return t.raw("documents").where(F.concat("text", F.element_at(tails, (F.col("doc_id") % 6 + 1).cast("int"))).rlike(texts.ACCUSATORY)).select("doc_id")


# --- contracts' texts ------------------------------------------------------------------------------------------------------------------------


FLAT = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query("str11_citations", f"""
SELECT b.item_id AS field, d.doc_id, strpos(d.page, b.quote) - 1 AS span_start FROM (SELECT doc_id, {FLAT.format('text')} AS page FROM documents) d, (SELECT item_id, {FLAT.format('text')} AS quote FROM benchmark) b WHERE contains(d.page, b.quote) AND length(b.quote) >= 8""")
def str11(t):
    """Benchmark passages as quotes cited from documents; which document may hold which quote is found by the quotes' rarest word."""
    d = t.raw("documents").select("doc_id", texts.normalize_quote(F.col("text")).alias("page"))
    b = t.raw("benchmark").select(F.col("item_id").alias("field"), texts.normalize_quote(F.col("text")).alias("quote"))
    inner = F.expr("slice(split(quote, ' '), 2, size(split(quote, ' ')) - 2)")  # the outer words may be parts of longer ones in the page
    words = d.select("doc_id", F.explode(F.array_distinct(F.split("page", " "))).alias("w"))
    wanted = b.select("field", F.explode(F.array_distinct(inner)).alias("w"))
    df = words.join(wanted.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count("*").alias("df"))
    rare = wanted.join(df, "w").groupBy("field").agg(F.min_by("w", F.struct("df", "w")).alias("w"))
    pairs = words.join(rare, "w").select(F.col("doc_id").alias("contract_id"), "field").distinct()
    cited = pairs.join(t.raw("benchmark").select(F.col("item_id").alias("field"), F.col("text").alias("quote")), "field").withColumns({"page": F.lit(1), "value": F.lit(None).cast("string")})
    pages = t.raw("documents").select(F.col("doc_id").alias("contract_id"), F.lit(1).alias("page"), "text")
    return contracts.citations(cited, pages).where("verified").select("field", F.col("contract_id").alias("doc_id"), "span_start")


@query("agg22_citation_rate", "SELECT contract_id % 4 AS ws, round(avg(CASE WHEN contract_id % 10 != 0 THEN 1.0 ELSE 0.0 END), 3) AS rate FROM contracts GROUP BY ALL")
def agg22(t):
    """A tenth of the quotes is made up; another one is genuine, but cited from a page that there isn't."""
    c = t.contracts()
    pages = c.select("contract_id", F.lit(1).alias("page"), F.concat(F.lit("The  Fee, is (payable)\nby "), "customer_name", F.lit(" monthly.")).alias("text"))
    cited = c.select("contract_id", F.lit("fee").alias("field"), F.lit("x").alias("value"), F.when(F.col("contract_id") % 10 == 5, 2).otherwise(1).alias("page"), F.when(F.col("contract_id") % 10 == 0, "never written anywhere").otherwise(F.concat(F.lit("the fee is payable by "), F.lower("customer_name"))).alias("quote"))
    return contracts.citations(cited, pages).groupBy((F.col("contract_id") % 4).alias("ws")).agg(F.round(F.avg(F.col("verified").cast("int")), 3).alias("rate"))


@query("str14_clauses")
def str14(t):
    return contracts.clauses(t.raw("documents").select("doc_id", F.lit(1).alias("page"), "text")).select("doc_id", "n", "heading", "start", "stop")


@query("str15_clause_scores", "SELECT doc_id, (CASE WHEN contains(b, 'fee') THEN 3.0 ELSE 0 END) + (CASE WHEN contains(b, 'fees') THEN 3.0 ELSE 0 END) + (CASE WHEN contains(b, 'rs') THEN 1.5 ELSE 0 END) + (CASE WHEN contains(b, 'inr') THEN 2.5 ELSE 0 END) + (CASE WHEN contains(b, 'amount') THEN 2.0 ELSE 0 END) + (CASE WHEN contains(b, 'per month') THEN 3.0 ELSE 0 END) + 1.5 * (3.0 + 3.0) AS score FROM (SELECT doc_id, lower(text || ' Fees INR per month') AS b FROM documents)")
def str15(t):
    return t.raw("documents").select("doc_id", texts.clause_score(F.concat("text", F.lit(" Fees INR per month")), F.lit("3. FEES"), "pricing").alias("score"))


@query("srt2_retrieved_clauses")
def srt2(t):
    pages = t.raw("documents").select("doc_id", F.lit(1).alias("page"), F.concat(F.lit("1. FEES\nThe fee is payable quarterly in advance.\n2. TERM\nThe term begins on the effective date.\n"), F.col("text")).alias("text"))
    return contracts.retrieved(contracts.clauses(pages))


# --- identity -----------------------------------------------------------------------------------------------------------------------------------


def _people(t: Tables) -> DataFrame:
    """Raw identity records: customers under five spellings, a third of them sharing a name's number; tax ids, mails and phones on some."""
    c, k = t.customers(), F.col("customer_id")
    g = F.floor(k / 3)
    rows = c.select(
        "ws", k.alias("id"), F.concat(F.lit("Zeta"), F.lpad(g.cast("string"), 5, "0"), F.lit(" "), F.initcap("segment"), F.element_at(F.array(*map(F.lit, (" Pvt Ltd", " Limited", ", Inc.", "", " LLP"))), (k % 5 + 1).cast("int"))).alias("name"),
        F.when(k % 4 == 0, F.concat(F.lit("a"), k.cast("string"), F.lit("@firm"), g.cast("string"), F.lit(".example"))).alias("email"), F.when(k % 7 == 0, F.concat(F.lit("98"), F.lpad(g.cast("string"), 8, "0"))).alias("phone"),
        F.when(k % 6 < 2, F.concat(F.lit("27ABCDE"), F.lpad((g % 10000).cast("string"), 4, "0"), F.lit("F1Z5"))).alias("tax_id"), F.lit(None).cast("string").alias("address"),
    )
    return rows.withColumn("ws", (F.floor(F.col("id") / 3) % 4).cast("int"))


@query("jn10_blocking", """
SELECT ws, l, r FROM (
 SELECT ws, l.id AS l, r.id AS r FROM keyed l JOIN keyed r USING (ws, key) JOIN fit USING (ws, key) WHERE l.id < r.id) GROUP BY ALL""",
    """people AS (SELECT CAST((customer_id // 3) % 4 AS INTEGER) AS ws, customer_id AS id, 'zeta' || lpad(CAST(customer_id // 3 AS VARCHAR), 5, '0') AS w, lower(segment) AS s, CASE WHEN customer_id % 4 = 0 THEN 'firm' || (customer_id // 3) || '.example' END AS domain, CASE WHEN customer_id % 4 = 0 THEN 'a' || customer_id || '@firm' || (customer_id // 3) || '.example' END AS email,
  CASE WHEN customer_id % 7 = 0 THEN '98' || lpad(CAST(customer_id // 3 AS VARCHAR), 8, '0') END AS phone, CASE WHEN customer_id % 6 < 2 THEN '27ABCDE' || lpad(CAST((customer_id // 3) % 10000 AS VARCHAR), 4, '0') || 'F1Z5' END AS tax FROM customers)""",
    """keyed AS (SELECT DISTINCT ws, id, unnest(list_concat(list_filter(['p' || substring(tax, 3, 10), 't' || tax, 'd' || domain, 'e' || email, 'f' || phone, 'w' || w, 'w' || s, 'x' || w[1:5]], lambda x: x IS NOT NULL), list_transform(generate_series(1, length(w || s) - 3), lambda i: 'g' || substring(w || s, CAST(i AS INTEGER), 4)))) AS key FROM people)""",
    "fit AS (SELECT ws, key FROM keyed GROUP BY ALL HAVING count(*) BETWEEN 2 AND 60)")
def jn10(t):
    return identity.candidate_pairs(identity.records(_people(t))).select("ws", "l", "r")


#: Close vectors of customers: those of one number share a direction.
CLOSE = 0.55


def _directions(t: Tables) -> DataFrame:
    """ws, id and vector of customers: mostly their number's vector, and some of another one."""
    e = t.raw("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = e.count()
    k = F.col("id")
    rows = _people(t).select("ws", "id", (F.floor(k / 3) * 7 % n).alias("a"), (k * 13 % n).alias("b"))
    rows = rows.join(e.select(F.col("vec_id").alias("a"), F.col("v").alias("va")), "a").join(e.select(F.col("vec_id").alias("b"), F.col("v").alias("vb")), "b")
    return rows.select("ws", "id", F.zip_with("va", "vb", lambda x, y: x * 0.8 + y * 0.5).alias("vector"))


def _scored(t) -> DataFrame:
    recs = staged(identity.records(_people(t)), "records")
    pairs = staged(identity.candidate_pairs(recs), "pairs")
    return identity.scored(pairs, recs, semantic.of_pairs(pairs, _directions(t)))


@query("idn1_exact_rules", "SELECT a.ws, a.id AS l, b.id AS r, 0.99 AS exact FROM pan a JOIN pan b ON a.ws = b.ws AND a.p = b.p AND a.id < b.id", "pan AS (SELECT CAST((customer_id // 3) % 4 AS INTEGER) AS ws, customer_id AS id, (customer_id // 3) % 10000 AS p FROM customers WHERE customer_id % 6 < 2)")
def idn1(t):
    return _scored(t).where("exact = 0.99").select("ws", "l", "r", "exact")


@query("idn2_fellegi_sunter")
def idn2(t):
    return _scored(t).withColumn("posterior", identity.posterior(F.col("weight"))).select("ws", "l", "r", "rule", "weight", "exact", "conflict", "decision", "posterior")


@query("idn3_cannot_link")
def idn3(t):
    return identity.cannot_link(_scored(t))


def _clusters(t) -> tuple[DataFrame, DataFrame]:
    recs = staged(identity.records(_people(t)), "records")
    met = staged(identity.candidate_pairs(recs), "pairs")
    pairs = staged(identity.settled(met, recs, lambda asked: semantic.of_pairs(asked, _directions(t))), "settled")
    return pairs, staged(identity.clusters(pairs), "clusters")


@query("idn4_clusters")
def idn4(t):
    return _clusters(t)[1]


@query("idn5_transitivity_conflicts")
def idn5(t):
    return identity.transitivity_conflicts(*_clusters(t))


@query("idn7_reviewer_memory")
def idn7(t):
    pairs = _scored(t)
    memory = pairs.where("l % 2 = 0").select("ws", F.col("r").alias("a"), F.col("l").alias("b"), F.lit("REJECTED").alias("verdict"))
    return identity.overridden(pairs, memory).groupBy("ws", "decision").agg(F.count("*").alias("n"))


@query("idn9_match_critic")
def idn9(t):
    return identity.criticised(_scored(t), identity.records(_people(t))).withColumn("objections", F.array_join("objections", ","))


@query("agg19_cluster_entropy", "SELECT ws, round(-sum(p * log2(p)), 6) AS entropy, count(*) AS clusters FROM (SELECT ws, n / sum(n) OVER (PARTITION BY ws) AS p FROM (SELECT ws, customer_id // 10 AS c, count(*) AS n FROM customers GROUP BY ALL)) GROUP BY ws")
def agg19(t):
    return identity.cluster_entropy(t.customers().select("ws", F.col("customer_id").alias("id"), F.floor(F.col("customer_id") / 10).alias("cluster")))


@query("agg20_canonical_records", """
SELECT ws, cluster, arg_max(name, (length(name), -id)) AS canonical_name, count(DISTINCT name) AS n_aliases, CASE WHEN count(*) = 1 THEN 1.0 ELSE 0.9 END AS confidence FROM (SELECT CAST((customer_id // 3) % 4 AS INTEGER) AS ws, customer_id // 3 AS cluster, customer_id AS id, 'Zeta' || lpad(CAST(customer_id // 3 AS VARCHAR), 5, '0') || ' ' || upper(segment[1]) || lower(segment[2:]) || [' Pvt Ltd', ' Limited', ', Inc.', '', ' LLP'][customer_id % 5 + 1] AS name FROM customers) GROUP BY ws, cluster""")
def agg20(t):
    recs = identity.records(_people(t))
    found = recs.select("ws", "id", F.floor(F.col("id") / 3).alias("cluster"))
    return identity.canonical(recs, found).select("ws", "cluster", "canonical_name", F.size("aliases").cast("long").alias("n_aliases"), "confidence")


@query("jn19_shared_attributes", "SELECT a.ws, a.attribute, a.cluster AS a, b.cluster AS b FROM att a JOIN att b ON a.ws = b.ws AND a.attribute = b.attribute AND a.cluster < b.cluster JOIN (SELECT ws, attribute FROM att GROUP BY ALL HAVING count(*) BETWEEN 2 AND 60) f ON f.ws = a.ws AND f.attribute = a.attribute", "att AS (SELECT DISTINCT ws, customer_id AS cluster, 'AC' || (customer_id // 2) % 400 AS attribute FROM customers)")
def jn19(t):
    rows = t.customers().select("ws", F.col("customer_id").alias("cluster"), F.concat(F.lit("AC"), (F.floor(F.col("customer_id") / 2) % 400).cast("string")).alias("attribute"))
    return identity.shared_attribute_pairs(rows)


@query("srt7_budgeted_selection", "SELECT ws, l, r FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY conflict DESC, weight, l, r) AS n FROM (SELECT ws, customer_id AS l, customer_id + 1 AS r, customer_id % 9 = 0 AS conflict, CAST(customer_id % 100 AS DOUBLE) AS weight FROM customers)) WHERE n <= 15")
def srt7(t):
    k = F.col("customer_id")
    rows = t.customers().select("ws", k.alias("l"), (k + 1).alias("r"), (k % 9 == 0).alias("conflict"), (k % 100).cast("double").alias("weight"))
    return review.budgeted(rows).select("ws", "l", "r")


@query("agg15_confusion", """SELECT source, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS recall FROM (
 SELECT source, count(*) FILTER (WHERE n_chars >= 1000 AND quality = 1) AS tp, count(*) FILTER (WHERE n_chars >= 1000 AND quality = 0) AS fp, count(*) FILTER (WHERE n_chars < 1000 AND quality = 1) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY source)""")
def agg15(t):
    rows = t.raw("documents").select("doc_id", "source", (F.col("n_chars") >= 1000).alias("said")).join(t.raw("labels").select("doc_id", (F.col("quality") == 1).alias("true")), "doc_id")
    return identity.confusion(rows, ["source"])


@query("agg15_blocking_recall", "SELECT CAST((customer_id // 3) % 4 AS INTEGER) AS ws, 1.0 AS recall FROM customers GROUP BY ALL HAVING count(*) FILTER (WHERE customer_id % 3 != 2) > 1")
def agg15b(t):
    """Customers of one number share their name's first word, so blocking must propose each with the next."""
    people = _people(t)
    pairs = people.select("ws", F.col("id").alias("l"), (F.col("id") + 1).alias("r")).where("l % 3 != 2").join(people.select("ws", F.col("id").alias("r")), ["ws", "r"])
    return identity.blocking_recall(identity.records(people), pairs)


@query("idn2_semantic_tier", f"""
SELECT a.ws, a.id AS l, b.id AS r, round(list_cosine_similarity(a.v, b.v), 4) AS similarity FROM directions a JOIN directions b ON a.ws = b.ws AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= {CLOSE}""",
    "n AS (SELECT count(*) AS n FROM embeddings)",
    "directions AS (SELECT CAST((customer_id // 3) % 4 AS INTEGER) AS ws, customer_id AS id, list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda x: x[1] * 0.8 + x[2] * 0.5) AS v FROM customers, n JOIN embeddings a ON a.vec_id = (customer_id // 3) * 7 % n.n JOIN embeddings b ON b.vec_id = customer_id * 13 % n.n)")
def semantic_tier(t):
    return semantic.similar(_directions(t), CLOSE, copies=True).withColumn("similarity", F.round("similarity", 4))


# --- windows and anomalies -----------------------------------------------------------------------------------------------------------------


@query("win1_a01_close_repeats", "SELECT event_id, previous_id FROM (SELECT event_id, ts, lag(event_id) OVER w AS previous_id, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE ts - before <= INTERVAL 1 DAY")
def win1(t):
    return anomaly.close_repeats(t.raw("events"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "previous_id")


@query("win2_running_counts", "SELECT payment_id, row_number() OVER w AS nth, coalesce(date_diff('day', lag(paid_on) OVER w, paid_on), -1) AS days_since FROM payments WINDOW w AS (PARTITION BY ws, customer_id ORDER BY paid_on, payment_id)")
def win2(t):
    return anomaly.running_counts(t.payments(), ["ws", "customer_id"], "paid_on", "payment_id").select("payment_id", "nth", "days_since")


@query("win3_near_duplicate_pairs", "SELECT user_id, event_type, first_id, event_id AS later_id FROM (SELECT *, first_value(event_id) OVER w AS first_id, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE n > 1")
def win3(t):
    return quality.near_duplicates(t.raw("events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id")


VERSIONS = """seen AS (SELECT source, doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS s FROM documents),
versions AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS superseded_by FROM seen WHERE s = 1)"""


def _versions(t) -> DataFrame:
    rows = t.raw("documents").select("source", "doc_id", F.sha2("text", 256).alias("h"))
    return quality.versions(rows, ["source"], ["doc_id"], "h", "doc_id").drop("h")


@query("win4_versions", "SELECT * FROM versions", VERSIONS)
def win4(t):
    return _versions(t)


@query("flt3_current_rows", "SELECT source, doc_id, version FROM versions WHERE superseded_by IS NULL", VERSIONS)
def flt3(t):
    return quality.current(_versions(t)).drop("superseded_by")


@query("srt4_latest_version", "SELECT source, arg_max(doc_id, version) AS doc_id FROM versions GROUP BY source", VERSIONS)
def srt4(t):
    return _versions(t).groupBy("source").agg(F.max_by("doc_id", "version").alias("doc_id"))


@query("a08_churn", "SELECT source, max(version) AS versions, 'MEDIUM' AS severity FROM versions GROUP BY source HAVING max(version) > 2", VERSIONS)
def a08(t):
    return anomaly.churned(_versions(t), ["source"])


@query("snk1_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'stored' WHEN o_orderkey % 3 = 1 THEN 'updated' ELSE 'inserted' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS price FROM orders")
def snk1(t):
    """A third of the orders is stored only, a third comes again with another price, a third is new."""
    o = t.raw("orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(1).alias("taken"))
    k = F.col("o_orderkey") % 3
    incoming = o.where(k > 0).select("o_orderkey", (F.col("price") + 1).alias("price"), F.lit(2).alias("taken"), F.when(k == 1, "updated").otherwise("inserted").alias("state"))
    return quality.upsert(o.where(k < 2).withColumn("state", F.lit("stored")), incoming, ["o_orderkey"], ["taken"]).select("o_orderkey", "state", "price")


@query("win9_hash_chain", """
SELECT conv_id, min(turn) AS broken_at, arg_min(CASE WHEN turn % 5 = 3 AND conv_id % 7 = 0 THEN 'hash_mismatch' END, turn) AS reason FROM conversations WHERE turn % 5 = 3 AND conv_id % 7 = 0 GROUP BY conv_id""")
def win9(t):
    """Chains of conversations in which a stored hash was forged: at turn 3 of every seventh."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.raw("conversations").select("conv_id", "turn", "role", "text")
    past = F.collect_list(F.struct("role", "text")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    true = F.aggregate(past, F.lit(None).cast("string"), lambda h, x: quality.chained_hash(h, x["role"], x["text"]))
    log = rows.withColumn("true", true)
    forged = (F.col("conv_id") % 7 == 0) & (F.col("turn") % 5 == 3)
    before = F.lag(F.when(forged, F.sha2(F.concat(F.lit("x"), "true"), 256)).otherwise(F.col("true"))).over(w)
    stored = F.when(forged, F.sha2(F.concat(F.lit("x"), "true"), 256)).when(F.lag(F.when(forged, 1)).over(w) == 1, quality.chained_hash(before, F.col("role"), F.col("text"))).otherwise(F.col("true"))
    log = log.withColumn("stored", stored)
    bad = quality.broken_links(log, ["conv_id"], "turn", "stored", ["role", "text"])
    return bad


@query("win10_ranking", "SELECT ws, contract_id, row_number() OVER (PARTITION BY ws ORDER BY CASE WHEN needs_human_review THEN 0 WHEN is_amendment THEN 1 ELSE 2 END, start_date, contract_id) AS place FROM contracts")
def win10(t):
    c = t.contracts()
    rows = c.select("ws", F.col("contract_id").alias("item_id"), F.when(F.col("needs_human_review"), "HIGH").when(F.col("is_amendment"), "MEDIUM").otherwise("LOW").alias("severity"), F.col("start_date").alias("created_on"))
    return review.ranked(rows).select("ws", F.col("item_id").alias("contract_id"), "place")


def _monthly(t) -> DataFrame:
    return t.invoices().groupBy("ws", F.date_format("issue_date", "yyyyMM").cast("int").alias("version")).agg(F.sum("total").alias("total"), F.count_if(F.col("status") == "paid").alias("paid"))


@query("win11_version_diff", """
SELECT ws, version, field, value, before, value - before AS change FROM (SELECT *, lag(value) OVER (PARTITION BY ws, field ORDER BY version) AS before FROM (
 SELECT ws, version, 'total' AS field, total AS value FROM m UNION ALL SELECT ws, version, 'paid', paid FROM m)) WHERE before IS NOT NULL AND value != before""", "m AS (SELECT ws, CAST(strftime(issue_date, '%Y%m') AS INTEGER) AS version, CAST(sum(total) AS BIGINT) AS total, count(*) FILTER (WHERE status = 'paid') AS paid FROM invoices GROUP BY ALL)")
def win11(t):
    return review.version_diff(_monthly(t), ["total", "paid"])


@query("ver1_publish_versions", "SELECT ws, taken_at, row_number() OVER (PARTITION BY ws ORDER BY taken_at) AS version FROM (SELECT *, lag(x) OVER (PARTITION BY ws ORDER BY taken_at) AS p FROM (SELECT ws, CAST(strftime(issue_date, '%Y%m') AS INTEGER) AS taken_at, count(*) % 3 AS x FROM invoices GROUP BY ALL)) WHERE p IS NULL OR p != x")
def ver1(t):
    snaps = t.invoices().groupBy("ws", F.date_format("issue_date", "yyyyMM").cast("int").alias("taken_at")).agg((F.count("*") % 3).alias("x"))
    return review.published_versions(snaps, ["x"]).select("ws", "taken_at", "version")


@query("win12_folds", "SELECT ws, CAST(least(5, greatest(2, count(*) // 20)) AS INTEGER) AS folds FROM contracts GROUP BY ws")
def win12(t):
    return t.contracts().groupBy("ws").agg(F.count("*").alias("n")).select("ws", anomaly.folds(F.col("n")).alias("folds"))


@query("agg9_a03_period_end_spike", f"""
SELECT w.ws, w.win AS "window", s.median, s.months, s.mad, (w.win - s.median) / CASE WHEN s.mad > 0 THEN s.mad ELSE s.median END >= 3 AS fires FROM (SELECT ws, CAST(sum(total) AS BIGINT) AS win FROM invoices WHERE issue_date BETWEEN {P1} - 14 AND {P1} GROUP BY ws) w
JOIN (SELECT ws, m.median, m.months, median(abs(amount - m.median)) AS mad FROM months JOIN (SELECT ws, median(amount) AS median, count(*) AS months FROM months GROUP BY ws) m USING (ws) GROUP BY ALL) s USING (ws) WHERE s.months >= 4""", f"months AS (SELECT ws, date_trunc('month', issue_date) AS month, CAST(sum(total) AS BIGINT) AS amount FROM invoices WHERE issue_date <= {P1} GROUP BY ALL)")
def agg9(t):
    return anomaly.period_end_spikes(t.invoices(), p1()).select("ws", "window", "median", "months", "mad", "fires")


@query("jn14_a02_rapid_refunds", "SELECT r.ws, r.refund_id, r.payment_id, date_diff('day', p.paid_on, r.refunded_on) AS days FROM refunds r JOIN payments p ON r.ws = p.ws AND r.payment_id = p.payment_id WHERE date_diff('day', p.paid_on, r.refunded_on) BETWEEN 0 AND 3")
def jn14(t):
    return anomaly.rapid_refunds(t.payments(), t.refunds()).select("ws", "refund_id", "payment_id", "days")


@query("a04_one_time_as_recurring", "SELECT i.ws, i.invoice_id, i.customer_id, c.contract_id, c.one_time_amount AS fee, 'HIGH' AS severity FROM invoices i JOIN contracts c ON i.ws = c.ws AND i.customer_id = c.customer_id WHERE i.has_one_time_items AND c.one_time_amount > 0")
def a04(t):
    return anomaly.one_time_as_recurring(t.invoices(), t.contracts())


@query("a05_future_value", f"SELECT ws, contract_id FROM contracts WHERE start_date > {P1} AND (recurring_amount > 0 OR one_time_amount > 0)")
def a05(t):
    """Contracts that lie wholly in the future; those that straddle the period's end are in dt3_dt4_dt5_period_allocation."""
    return anomaly.future_value(contracts.allocated_to_period(t.contracts(), p0(), p1()).where("rule = 'OUTSIDE_PERIOD_FUTURE'")).select("ws", "contract_id")


@query("agg11_a06_shared_accounts", "SELECT ws, account, count(DISTINCT customer_id) AS customers, CASE WHEN count(DISTINCT customer_id) = 2 THEN 'MEDIUM' ELSE 'HIGH' END AS severity FROM bank GROUP BY ws, account HAVING count(DISTINCT customer_id) >= 2")
def agg11(t):
    return anomaly.shared_accounts(t.bank().withColumn("payment_id", F.col("bank_id"))).drop("examples")


@query("agg10_a09_refund_rates", "SELECT ws, customer_id, paid, back, 'MEDIUM' AS severity FROM (SELECT ws, customer_id, paid, back, sum(back) OVER (PARTITION BY ws) / sum(paid) OVER (PARTITION BY ws) AS ws_rate FROM (SELECT ws, customer_id, CAST(sum(amount) AS BIGINT) AS paid, CAST(sum(amount_refunded) AS BIGINT) AS back FROM payments WHERE status != 'failed' GROUP BY ALL)) WHERE back / paid >= greatest(2 * ws_rate, 0.25)")
def agg10(t):
    return anomaly.refund_rates(t.payments().where("status != 'failed'").withColumnRenamed("amount_refunded", "refunded")).select("ws", "customer_id", "paid", "back", "severity")


def _flows(t) -> DataFrame:
    l, o, s = t.raw("lineitem").select("l_orderkey", "l_suppkey"), t.raw("orders").select("o_orderkey", "o_custkey"), t.raw("supplier").select("s_suppkey", "s_nationkey")
    e = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(t.customers().select("customer_id", "nation"), F.col("o_custkey") == F.col("customer_id"))
    return e.groupBy(F.col("nation").cast("long").alias("u"), F.col("s_nationkey").cast("long").alias("v")).agg(F.count("*").alias("n")).where((F.col("n") % 11 == 0) & (F.col("u") != F.col("v"))).select("u", "v")


FLOWS = "flows AS (SELECT CAST(c.c_nationkey AS BIGINT) AS u, CAST(s.s_nationkey AS BIGINT) AS v FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY ALL HAVING count(*) % 11 = 0 AND c.c_nationkey != s.s_nationkey)"


@query("gra1_components", "SELECT node, min(r) AS label FROM (SELECT node, r FROM (WITH RECURSIVE w(node, r) AS (SELECT u, v FROM both_ UNION SELECT w.node, b.v FROM w JOIN both_ b ON w.r = b.u) SELECT * FROM w)) GROUP BY node", FLOWS, "both_ AS (SELECT u, v FROM flows UNION SELECT v, u FROM flows)")
def gra1(t):
    return graph.components(_flows(t))


@query("gra2_strong_components", """SELECT node, min(m) AS label FROM (SELECT u AS node, u AS m FROM flows UNION SELECT v, v FROM flows UNION SELECT a.s, a.t FROM reach a JOIN reach b ON a.s = b.t AND a.t = b.s) GROUP BY node""", FLOWS, "reach AS (WITH RECURSIVE w(s, t) AS (SELECT u, v FROM flows UNION SELECT w.s, f.v FROM w JOIN flows f ON w.t = f.u) SELECT * FROM w)")
def gra2(t):
    return graph.strongly_connected(_flows(t))


@query("gra3_a11_cycles", """SELECT * FROM (
 WITH RECURSIVE w(head, pos, path) AS (SELECT u, v, [u, v] FROM flows WHERE u < v UNION ALL SELECT w.head, f.v, list_append(w.path, f.v) FROM w JOIN flows f ON w.pos = f.u WHERE f.v > w.head AND NOT list_contains(w.path, f.v) AND len(w.path) < 6)
 SELECT len(path) AS n, array_to_string(path, '>') AS path FROM w JOIN flows f ON w.pos = f.u AND f.v = w.head)""", FLOWS)
def gra3(t):
    """Cycles of up to six nodes, each once, from its lowest node."""
    found = graph.cycles(_flows(t), 6)
    return found.select(F.col("n").cast("long").alias("n"), F.array_join("path", ">").alias("path"))


@query("jn20_neighbourhood", """SELECT node, near, min(d) AS distance FROM (
 WITH RECURSIVE w(node, near, d) AS (SELECT u, v, 1 FROM both_ WHERE u < 5 UNION SELECT w.node, b.v, d + 1 FROM w JOIN both_ b ON w.near = b.u WHERE d < 3) SELECT * FROM w) WHERE node != near GROUP BY ALL""", FLOWS, "both_ AS (SELECT u, v FROM flows UNION SELECT v, u FROM flows)")
def jn20(t):
    e = _flows(t)
    start = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct().where("node < 5")
    return graph.neighbourhood(e, start, 3)


#: Customers that share a domain, dozens of ids each, or an account, dozens that overlap them.
SHARING = """shared AS (SELECT DISTINCT a.ws, a.customer_id AS a, b.customer_id AS b, k.kind, a_key AS attribute FROM (SELECT 'domain' AS kind, 0 AS shift UNION ALL SELECT 'account', 4) k
 JOIN (SELECT ws, customer_id FROM customers) a ON true JOIN (SELECT ws, customer_id FROM customers) b ON a.ws = b.ws AND a.customer_id < b.customer_id AND b.customer_id < a.customer_id + 12 AND (a.customer_id + k.shift) // 12 = (b.customer_id + k.shift) // 12,
 LATERAL (SELECT k.kind || (a.customer_id + k.shift) // 12 AS a_key)),
both_s AS (SELECT ws, a AS u, b AS v, kind, attribute, a || '-' || b || kind AS e FROM shared UNION ALL SELECT ws, b, a, kind, attribute, a || '-' || b || kind FROM shared),
paths AS (WITH RECURSIVE w(ws, source, pos, hops, nodes, kinds, attributes, used) AS (
  SELECT ws, u, v, 1, [u, v], [kind], [attribute], [e] FROM both_s
  UNION ALL SELECT w.ws, source, b.v, hops + 1, list_append(nodes, b.v), list_append(kinds, b.kind), list_append(attributes, b.attribute), list_append(used, b.e) FROM w JOIN both_s b ON w.ws = b.ws AND w.pos = b.u WHERE hops < {depth} AND NOT list_contains(used, b.e)) SELECT * FROM w WHERE source < pos)"""
PATH = "SELECT ws, source, pos AS target, hops, array_to_string(nodes, '>') AS nodes, array_to_string(kinds, ',') AS kinds, array_to_string(attributes, ',') AS attributes FROM"


def _paths(t: Tables, depth: int, limit: int | None = None) -> DataFrame:
    keyed = lambda kind, shift: t.customers().select("ws", F.col("customer_id").alias("cluster"), F.concat(F.lit(kind), F.floor((F.col("customer_id") + shift) / 12).cast("string")).alias("attribute"))
    edges = [identity.shared_attribute_pairs(keyed(kind, shift)).withColumn("kind", F.lit(kind)) for kind, shift in (("domain", 0), ("account", 4))]
    rows = graph.connecting_paths(edges[0].unionByName(edges[1]), depth, limit)
    return rows.select("ws", "source", "target", "hops", F.array_join(F.col("nodes").cast("array<string>"), ">").alias("nodes"), F.array_join("kinds", ",").alias("kinds"), F.array_join("attributes", ",").alias("attributes"))


@query("jn20_relationship_paths", f"{PATH} paths", SHARING.format(depth=3))
def jn20_paths(t):
    """All paths of three edges at most between customers."""
    return _paths(t, 3)


@query("jn20_first_paths", f"{PATH} (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY hops, source, pos, nodes, kinds, attributes) AS n FROM paths) WHERE n <= 200", SHARING.format(depth=4))
def jn20_first(t):
    """The 200 shortest of each workspace, up to four edges."""
    return _paths(t, 4, 200)


@query("a10_related_parties", "SELECT label, count(*) AS nodes, count(*) FILTER (WHERE kind = 'customer') AS customers FROM (SELECT least_ AS label, kind FROM (SELECT ws * 1000 + acc AS least_, 'account' AS kind FROM cu GROUP BY ALL UNION ALL SELECT ws * 1000 + acc, 'customer' FROM cu)) GROUP BY label HAVING count(*) >= 3 AND count(*) FILTER (WHERE kind = 'customer') >= 2", "cu AS (SELECT DISTINCT ws, customer_id, (customer_id // 2) % 400 AS acc FROM customers)")
def a10(t):
    acc = F.col("ws") * 1000 + F.floor(F.col("customer_id") / 2) % 400
    e = t.customers().select(acc.cast("long").alias("u"), (F.col("customer_id") + 1_000_000).alias("v"))
    kinds = e.select(F.col("u").alias("node"), F.lit("account").alias("kind")).distinct().unionByName(e.select(F.col("v").alias("node"), F.lit("customer").alias("kind")))
    return anomaly.related_parties(graph.components(e), kinds).drop("severity")


#: Names of 1 to 55 letters, most with a common first word; the last letter is a digit.
NAMED = "nm AS (SELECT CAST(p_partkey % 4 AS INTEGER) AS ws, p_partkey AS id, CASE WHEN p_partkey % 4 > 0 AND p_partkey % 5 > 0 THEN 'firma ' ELSE '' END || trim(substr(p_name, 1, p_partkey % 56)) || (p_partkey % 3) AS n FROM part)"
CONTAINED = "held AS (SELECT DISTINCT a.ws, a.n AS x, b.n AS y FROM nm a JOIN nm b ON a.ws = b.ws AND a.n != b.n AND contains(b.n, a.n))"


def _part_names(t) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.when((k % 4 > 0) & (k % 5 > 0), "firma ").otherwise(""), F.trim(F.substr(F.col("p_name"), F.lit(1), (k % 56).cast("int"))), (k % 3).cast("string"))
    return t.raw("part").select((k % 4).cast("int").alias("ws"), k.alias("id"), name.alias("name"))


@query("jn15_contained_names", "SELECT DISTINCT a.ws, least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM nm a JOIN nm b ON a.ws = b.ws AND a.id != b.id AND contains(b.n, a.n)", NAMED)
def jn15(t):
    return anomaly.contained_parties(_part_names(t), "id")


@query("a13_name_groups", """
SELECT nm.ws, id, n AS name, group_name, names FROM nm JOIN (SELECT ws, x, min(y) AS group_name, count(*) AS names FROM reach GROUP BY ws, x) r ON nm.ws = r.ws AND nm.n = r.x""", NAMED, CONTAINED,
    "both_held AS (SELECT ws, x, y FROM held UNION SELECT ws, y, x FROM held)",
    "reach AS (WITH RECURSIVE w(ws, x, y) AS (SELECT DISTINCT ws, x, x FROM both_held UNION SELECT w.ws, w.x, h.y FROM w JOIN both_held h ON w.ws = h.ws AND w.y = h.x) SELECT * FROM w)")
def a13(t):
    """Names that hold one another, as groups."""
    return anomaly.name_groups(_part_names(t), "id")


@query("jn13_debit_refund_match")
def jn13(t):
    """Amounts in millions, so that many debits share one; every tenth refund has no date."""
    b = t.payments().where("amount_refunded > 0").select("ws", (F.col("payment_id") + 7).alias("debit_id"), F.floor(F.col("amount_refunded") / 1_000_000).cast("long").alias("amount"), F.col("paid_on").alias("booked_on"))
    r = t.refunds().select("ws", "refund_id", F.floor(F.col("amount") / 1_000_000).cast("long").alias("amount"), F.when(F.col("refund_id") % 10 != 0, F.col("refunded_on")).alias("refunded_on"))
    return anomaly.matched_debits(b, r)


@query("jn12_contract_key_alignment", "SELECT c.key AS contract_key, CASE WHEN i.key IS NOT NULL THEN c.key ELSE o.key END AS aligned FROM (SELECT DISTINCT p_name || ' ' || (p_partkey % 40) AS key, p_name AS core FROM part) c LEFT JOIN (SELECT DISTINCT p_name || ' ' || (p_partkey % 37) AS key FROM part) i ON i.key = c.key LEFT JOIN (SELECT core, min(key) AS key FROM (SELECT DISTINCT p_name AS core, p_name || ' ' || (p_partkey % 37) AS key FROM part) GROUP BY core HAVING count(*) = 1) o ON o.core = c.core")
def jn12(t):
    """Parts under two numberings: a contract's key is the name with one, an invoice's with the other."""
    keyed = lambda n: t.raw("part").select(F.concat(F.col("p_name"), F.lit(" "), (F.col("p_partkey") % n).cast("string")).alias("key"), F.col("p_name").alias("core"))
    return contracts.aligned_keys(keyed(40), keyed(37))


def _findings(t) -> DataFrame:
    """Findings of five rules, those of the first twice."""
    ref = lambda kind, c: F.array(F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")))
    parts = [
        anomaly.rapid_refunds(t.payments(), t.refunds()).select("ws", F.lit("A02").alias("rule"), F.concat(ref("refund", "refund_id"), ref("payment", "payment_id")).alias("records")),
        anomaly.one_time_as_recurring(t.invoices(), t.contracts()).select("ws", F.lit("A04").alias("rule"), ref("invoice", "invoice_id").alias("records")),
        anomaly.future_value(contracts.allocated_to_period(t.contracts(), p0(), p1()).where("rule = 'OUTSIDE_PERIOD_FUTURE'")).select("ws", F.lit("A05").alias("rule"), ref("contract", "contract_id").alias("records")),
        anomaly.shared_accounts(t.bank().withColumn("payment_id", F.col("bank_id"))).select("ws", F.lit("A06").alias("rule"), ref("account", "account").alias("records")),
        anomaly.refund_rates(t.payments().where("status != 'failed'").withColumnRenamed("amount_refunded", "refunded")).select("ws", F.lit("A09").alias("rule"), ref("customer", "customer_id").alias("records")),
    ]
    out = parts[0]
    for p in parts:
        out = out.unionByName(p)
    return out


FINDINGS = f"""findings AS (SELECT r.ws, 'A02' AS rule, 'payment:' || r.payment_id || ',refund:' || r.refund_id AS refs FROM refunds r JOIN payments p ON r.ws = p.ws AND r.payment_id = p.payment_id WHERE date_diff('day', p.paid_on, r.refunded_on) BETWEEN 0 AND 3
 UNION ALL SELECT i.ws, 'A04', 'invoice:' || i.invoice_id FROM invoices i JOIN contracts c ON i.ws = c.ws AND i.customer_id = c.customer_id WHERE i.has_one_time_items AND c.one_time_amount > 0
 UNION ALL SELECT ws, 'A05', 'contract:' || contract_id FROM contracts WHERE start_date > {P1} AND (recurring_amount > 0 OR one_time_amount > 0)
 UNION ALL SELECT ws, 'A06', 'account:' || account FROM bank GROUP BY ws, account HAVING count(DISTINCT customer_id) >= 2
 UNION ALL SELECT ws, 'A09', 'customer:' || customer_id FROM (SELECT ws, customer_id, paid, back, sum(back) OVER (PARTITION BY ws) / sum(paid) OVER (PARTITION BY ws) AS ws_rate FROM (SELECT ws, customer_id, CAST(sum(amount) AS BIGINT) AS paid, CAST(sum(amount_refunded) AS BIGINT) AS back FROM payments WHERE status != 'failed' GROUP BY ALL)) WHERE back / paid >= greatest(2 * ws_rate, 0.25))"""


@query("set2_fingerprints", "SELECT ws, rule, sha256(rule || '|' || refs) AS fingerprint FROM findings", FINDINGS)
def set2(t):
    return anomaly.fingerprints(_findings(t)).select("ws", "rule", "fingerprint")


@query("set3_set4_rescan", """
SELECT coalesce(p.ws, n.ws) AS ws, coalesce(p.f, n.f) AS fingerprint, coalesce(p.status, 'OPEN') AS status, n.f IS NOT NULL AS fires, p.f IS NOT NULL AS known
FROM (SELECT ws, f, CASE WHEN f < '4' THEN 'CONFIRMED' ELSE 'OPEN' END AS status FROM prints WHERE f < 'a') p FULL JOIN (SELECT ws, f FROM prints WHERE f > '2') n ON p.ws = n.ws AND p.f = n.f WHERE n.f IS NOT NULL OR p.status != 'OPEN'""", FINDINGS, "prints AS (SELECT ws, sha256(rule || '|' || refs) AS f FROM findings)")
def set3(t):
    f = anomaly.fingerprints(_findings(t)).select("ws", "fingerprint")
    previous = f.where("fingerprint < 'a'").withColumn("status", F.when(F.col("fingerprint") < "4", "CONFIRMED").otherwise("OPEN"))
    return anomaly.rescanned(previous, f.where("fingerprint > '2'"))


@query("agg14_precision", "SELECT rule, confirmed, labelled, round(confirmed / labelled, 3) AS precision, NOT (rule = 'A12' AND labelled >= 10 AND round(confirmed / labelled, 3) < 0.5) AS enabled FROM (SELECT 'A' || (10 + customer_id % 4) AS rule, count(*) FILTER (WHERE customer_id % 9 = 0) AS confirmed, count(*) FILTER (WHERE customer_id % 9 < 3) AS labelled FROM customers GROUP BY ALL)")
def agg14(t):
    k = F.col("customer_id")
    rows = t.customers().select(F.concat(F.lit("A"), (k % 4 + 10).cast("string")).alias("rule"), F.when(k % 9 == 0, "CONFIRMED").when(k % 9 < 3, "DISMISSED").otherwise("OPEN").alias("status"))
    return anomaly.precision(rows)


def _payment_features(t) -> DataFrame:
    rows = anomaly.running_counts(t.payments(), ["ws", "customer_id"], "paid_on", "payment_id")
    return anomaly.features(rows.withColumn("paid_at", F.timestamp_seconds(F.unix_seconds(F.col("paid_on").cast("timestamp")) + F.col("payment_id") % 86_400)))


@query("mlf_features", "SELECT payment_id, CAST(amount_refunded AS DOUBLE) / amount AS refund_ratio, (payment_id % 86400) // 3600 AS hour, day(paid_on) AS day_of_month FROM payments WHERE amount > 0")
def mlf_features(t):
    return _payment_features(t).select("payment_id", "refund_ratio", F.col("hour").cast("long").alias("hour"), F.col("day_of_month").cast("long").alias("day_of_month"))


@query("mlf_a12_outliers")
def mlf(t):
    return anomaly.outliers(_payment_features(t))


@query("mlf_drift")
def mlf_drift(t):
    return anomaly.drift(_payment_features(t))


# --- review, sets, impact --------------------------------------------------------------------------------------------------------------------


def _review_items(t) -> DataFrame:
    k = F.col("contract_id")
    return t.contracts().select("ws", k.alias("item_id"), F.when(k % 3 == 0, "HIGH").when(k % 3 == 1, "MEDIUM").otherwise("LOW").alias("severity"), F.when(k % 4 == 0, "RESOLVED").otherwise("OPEN").alias("status"), F.col("start_date").alias("created_on"), F.concat(F.lit("q"), (k % 10).cast("string")).alias("question_key"))


REVIEW_ITEMS = "ri AS (SELECT ws, contract_id AS item_id, CASE contract_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE WHEN contract_id % 4 = 0 THEN 'RESOLVED' ELSE 'OPEN' END AS status, start_date AS created_on, 'q' || contract_id % 10 AS question_key FROM contracts)"


@query("agg16_review_queue", f"SELECT ws, severity, count(*) AS n, max(date_diff('day', created_on, {P1})) AS oldest_days, count(DISTINCT question_key) AS questions FROM ri WHERE status = 'OPEN' GROUP BY ALL", REVIEW_ITEMS)
def agg16(t):
    return review.queue(_review_items(t), p1())


@query("rev1_resolve_group", "SELECT ws, item_id, CASE WHEN status = 'OPEN' AND question_key IN ('q1', 'q3') THEN 'RESOLVED' ELSE status END AS status, CASE WHEN status = 'OPEN' AND question_key IN ('q1', 'q3') THEN 'ACCEPT' END AS decision FROM ri", REVIEW_ITEMS)
def rev1(t):
    items = _review_items(t)
    told = items.where("question_key IN ('q1', 'q3', 'q5')").select("ws", "question_key", F.lit("ACCEPT").alias("decision"), F.when(F.col("question_key") != "q5", "checked").otherwise(" ").alias("reason")).distinct()
    return review.resolved(items, told).select("ws", "item_id", "status", "decision")


@query("jn17_anomalies_of_items", """
SELECT i.ws, i.item_id, count(*) AS n, bool_or(a.high) AS open_high FROM i JOIN a USING (ws) WHERE a.invoice_id = i.item_id OR a.payment_id = i.item_id GROUP BY ALL
UNION ALL SELECT i.ws, i.item_id, count(*), bool_or(a.high) FROM i JOIN a ON a.ws = i.ws AND a.customer_id = i.customer_id WHERE NOT EXISTS (SELECT 1 FROM a o WHERE o.ws = i.ws AND (o.invoice_id = i.item_id OR o.payment_id = i.item_id)) GROUP BY ALL""",
    "i AS (SELECT ws, invoice_id AS item_id, customer_id FROM invoices)",
    "a AS (SELECT ws, invoice_id, NULL AS payment_id, NULL AS customer_id, true AS high FROM invoices WHERE invoice_id % 10 = 0 UNION ALL SELECT ws, NULL, payment_id, NULL, false FROM payments WHERE payment_id % 15 = 0 UNION ALL SELECT ws, NULL, NULL, customer_id, false FROM customers WHERE customer_id % 7 = 0)")
def jn17(t):
    """Anomalies of invoices, payments and customers; a customer's count for the items that have none of their own."""
    items = t.invoices().select("ws", F.col("invoice_id").alias("item_id"), "invoice_id", F.array("invoice_id").alias("payment_ids"), "customer_id")
    def found(rows, sign, severity, kind, key, customer=None):
        none = F.lit(None).cast("bigint")
        refs = F.array(F.struct(F.lit(kind).alias("kind"), F.col(key).alias("id")))
        return rows.select("ws", F.concat(F.lit(sign), F.col(key).cast("string")).alias("anomaly_id"), F.lit(severity).alias("severity"), F.lit("OPEN").alias("status"), refs.alias("records"), (F.col(customer) if customer else none).alias("customer_id"))
    a = found(t.invoices().where("invoice_id % 10 = 0"), "i", "HIGH", "invoice", "invoice_id").unionByName(found(t.payments().where("payment_id % 15 = 0"), "p", "LOW", "payment", "payment_id"))
    a = a.unionByName(found(t.customers().where("customer_id % 7 = 0"), "c", "LOW", "customer", "customer_id", "customer_id"))
    return review.anomalies_of(items, a).select("ws", "item_id", F.size("anomalies").cast("long").alias("n"), F.col("open_high_anomaly").alias("open_high"))


@query("set5_entities_without_evidence", "SELECT ws, customer_id FROM (SELECT ws, customer_id FROM customers UNION ALL SELECT ws, customer_id + 1000000 FROM customers WHERE customer_id % 9 = 0) c WHERE NOT EXISTS (SELECT 1 FROM (SELECT ws, customer_id FROM invoices UNION SELECT ws, customer_id FROM payments UNION SELECT ws, customer_id FROM bank UNION SELECT ws, customer_id FROM contracts) e WHERE e.customer_id = c.customer_id AND e.ws = c.ws)")
def set5(t):
    """Customers, and some that nothing names."""
    c = t.customers().select("ws", "customer_id")
    known = c.unionByName(c.where("customer_id % 9 = 0").withColumn("customer_id", F.col("customer_id") + 1_000_000))
    return identity.without_evidence(known, t.invoices(), t.payments(), t.bank(), t.contracts())


@query("set6_arr1_token_sets", "SELECT p_partkey, array_to_string(list_sort(list_filter(string_split(p_name, ' '), lambda x: NOT list_contains(string_split(lower(p_type) || ' red blue', ' '), x))), ' ') AS own, len(list_intersect(string_split(p_name, ' '), ['red', 'blue', 'ring'])) AS common FROM part")
def set6(t):
    w = F.split("p_name", " ")
    return t.raw("part").select("p_partkey", F.array_join(F.array_sort(F.array_except(w, F.split(F.concat(F.lower("p_type"), F.lit(" red blue")), " "))), " ").alias("own"), F.size(F.array_intersect(w, F.array(F.lit("red"), F.lit("blue"), F.lit("ring")))).cast("long").alias("common"))


@query("agg23_change_impact", "SELECT ws, count(DISTINCT customer_id) AS customers, 'anomaly,contracts,reconciliation,revenue,review' AS stages FROM (SELECT ws, customer_id FROM contracts WHERE start_date > DATE '1997-06-01' UNION ALL SELECT ws, customer_id FROM bank WHERE booked_on > DATE '1997-06-01') GROUP BY ws")
def agg23(t):
    c = t.contracts().where("start_date > DATE'1997-06-01'").select("ws", "customer_id", F.lit("contract").alias("record_type"))
    b = t.bank().where("booked_on > DATE'1997-06-01'").select("ws", "customer_id", F.lit("bank").alias("record_type"))
    return review.impact(c.unionByName(b)).select("ws", "customers", F.array_join("stages", ",").alias("stages"))


@query("srt1_srt3_top_candidates", "SELECT ws, key, id, place FROM (SELECT CAST(event_id % 4 AS INTEGER) AS ws, user_id AS key, event_id AS id, row_number() OVER (PARTITION BY event_id % 4, user_id ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 5")
def srt3(t):
    """The best candidates of each record; events stand in for scored candidates of users."""
    e = t.raw("events").select((F.col("event_id") % 4).cast("int").alias("ws"), F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("value").alias("score"))
    return review.best(e, ["ws", "key"], "score", "id", 5).select("ws", "key", "id", "place")


@query("srt1_ranked_pairs", "SELECT invoice_id, payment_id, row_number() OVER (PARTITION BY ws, invoice_id ORDER BY score DESC, payment_id) AS place FROM (SELECT i.ws, i.invoice_id, p.payment_id, least(100, CASE WHEN date_diff('day', i.issue_date, p.paid_on) BETWEEN 0 AND 45 THEN 25 ELSE 5 END + CASE WHEN coalesce(contains(regexp_replace(lower(p.reference), '[^a-z0-9]', '', 'g'), regexp_replace(lower(i.invoice_number), '[^a-z0-9]', '', 'g')), false) THEN 50 ELSE 0 END + 30 + CASE WHEN abs(p.amount - i.total) <= 100 THEN 45 WHEN p.amount < i.total THEN 20 ELSE 15 END) AS score FROM invoices i JOIN payments p ON i.ws = p.ws AND i.currency = p.currency AND i.customer_id = p.customer_id WHERE i.status NOT IN ('void', 'draft') AND p.status != 'failed' AND date_diff('day', i.issue_date, p.paid_on) BETWEEN -30 AND 120) QUALIFY place <= 3")
def srt1(t):
    """SRT1: an invoice's three best payments."""
    found = reconcile.invoice_payment_candidates(t.invoices(), t.payments())
    return review.best(found, ["ws", "invoice_id"], "score", "payment_id", 3).select("invoice_id", "payment_id", "place")


@query("srt5_newest_changes", "SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY version DESC, doc_id DESC) AS place FROM versions) WHERE place <= 20", VERSIONS)
def srt5(t):
    """The newest versions of every source."""
    return review.newest(_versions(t), ["source"], ["version", "doc_id"], 20).select("source", "doc_id", "place")


@query("mth1_posterior", "SELECT event_id, round(pow(2, w) / (1 + pow(2, w)), 9) AS p FROM (SELECT event_id, greatest(-60, least(60, value - 15)) AS w FROM events)")
def mth1(t):
    return t.raw("events").select("event_id", F.round(identity.posterior(F.col("value") - 15), 9).alias("p"))


@query("jsn1_jsn2_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50")
def jsn(t):
    e = t.raw("events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))
    return e.where("k >= 50")
