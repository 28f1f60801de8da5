"""What a reviewer reads of one workspace, and the two decisions that they make: each is a filter by workspace, an order and at most a page of rows.

Tables by name, each with ws: entities, matches, memory, contracts, citations, invoices, payments, refunds, bank, allocations, claims, items, judgements, anomalies,
review_items, versions, raw_records, quarantined, audit and edges. A read asks only for the tables that it names; nothing is computed before an action. Orders end
in an id, so that ties don't decide what a page holds. A page's size is the caller's and bounded by `PAGES`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import anomaly, graph, quality, review, revenue

#: Usual and largest number of rows on a page.
PAGES = {"matches": (100, 500), "review": (100, 500), "evidence": (50, 200), "quarantine": (100, 500), "audit": (100, 500), "changes": (200, 200)}
#: What is counted on the front page, in its order.
COUNTED = (
    "raw_records", "entities", "contracts", "invoices", "payments", "refunds", "bank", "allocations", "items", "anomalies", "judgements", "versions",
)
#: The order of verdicts and of severities.
VERDICTS = ("DISPUTED", "MORE_EVIDENCE_REQUIRED", "APPROVED")
SEVERITIES = ("HIGH", "MEDIUM", "LOW", "INFO")
UNREAD = "terms_not_yet_extracted"


def rank(value: Column, names: tuple[str, ...]) -> Column:
    """Place of a name in a list; names that aren't in it come last."""
    place = F.array_position(F.array(*map(F.lit, names)), F.upper(value))
    return F.when(place > 0, place - 1).otherwise(9)


class Workspace:
    def __init__(self, ws, tables: dict[str, DataFrame]):
        self.ws, self.tables = ws, tables

    def of(self, name: str) -> DataFrame:
        """SRC11: the workspace's rows of a table."""
        return self.tables[name].where(F.col("ws") == self.ws)

    def _page(self, kind: str, rows: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
        usual, most = PAGES[kind]
        size = usual if limit is None else limit
        if not 1 <= size <= most:
            raise ValueError(f"a page of {kind} has 1 to {most} rows")
        return rows.orderBy(*order).limit(size)

    # --- identity ---------------------------------------------------------------------------------------------------------------------------------------

    def customers(self) -> DataFrame:
        return self.of("entities").orderBy("canonical_name", "entity_id")

    def matches(self, decision: str | None = None, limit: int | None = None) -> DataFrame:
        """Scored links, the rejected ones too: why two records were not merged is asked as often as why they were."""
        rows = self.of("matches")
        rows = rows.where(F.col("decision") == decision.upper()) if decision else rows
        return self._page("matches", rows, limit, F.desc("score"), "match_id")

    def match_counts(self) -> DataFrame:
        return self.of("matches").groupBy("decision").agg(F.count("*").alias("n"))

    def decide(self, match_id, decision: str, reason: str) -> dict[str, DataFrame]:
        """A person's decision on a link: the link takes it, the pair is remembered in this workspace, and the open question of the pair is resolved.
        Returns the three tables with the decision in them; other workspaces' rows stay as they are."""
        if not reason or not reason.strip():
            raise ValueError("a decision needs a reason")
        this = (F.col("ws") == self.ws) & (F.col("match_id") == F.lit(match_id))
        matches = self.tables["matches"]
        told = matches.where(this)
        note = F.concat(F.lit("Human decision: "), F.lit(reason))
        decided = matches.withColumns({
            "decision": F.when(this, F.lit(decision)).otherwise(F.col("decision")), "decided_by": F.when(this, F.lit("human")).otherwise(F.col("decided_by")),
            "critic_note": F.when(this, note).otherwise(F.col("critic_note")),
        })
        remembered = told.select("ws", F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"), F.lit(decision).alias("verdict"))
        memory = quality.upsert(self.tables["memory"], remembered, ["ws", "a", "b"], ["verdict"])
        title = told.select("ws", F.concat("left_label", F.lit(" ↔ "), "right_label").alias("title"), F.lit(True).alias("hit")).distinct()
        asked = self.tables["review_items"].join(F.broadcast(title), ["ws", "title"], "left")  # the titles of one link
        hit = F.col("hit") & (F.col("category") == "ambiguous_match") & (F.col("status") == "OPEN")
        items = asked.withColumns({
            "resolution": F.when(hit, F.lit(decision)).otherwise(F.col("resolution")), "reason": F.when(hit, F.lit(reason)).otherwise(F.col("reason")),
            "status": F.when(hit, F.lit("RESOLVED")).otherwise(F.col("status")),
        })
        return {"matches": decided, "memory": memory, "review_items": items.select(*self.tables["review_items"].columns)}

    def neighbourhood(self, node: str, depth: int = 2) -> DataFrame:
        """JN20: what lies within some steps of one node of the evidence graph."""
        if not 1 <= depth <= 3:
            raise ValueError("a neighbourhood has a depth of 1 to 3")
        edges = self.of("edges")
        return graph.neighbourhood(edges, edges.sparkSession.createDataFrame([(node,)], "node string"), depth).select("near", "distance")

    def relationships(self, depth: int = 2) -> DataFrame:
        """Entities (nodes "customer:...") that share domains, addresses or accounts, with their distance; an observation, not a legal relationship."""
        if not 1 <= depth <= 4:
            raise ValueError("relationships have a depth of 1 to 4")
        edges = self.of("edges")
        ends = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).where(F.col("node").startswith("customer:")).distinct()
        near = graph.neighbourhood(edges, ends, depth)
        return near.where(F.col("near").startswith("customer:") & (F.col("node") < F.col("near"))).orderBy("distance", "node", "near")

    # --- contracts, reconciliation, revenue -----------------------------------------------------------------------------------------------------------------

    def contracts(self) -> DataFrame:
        return self.of("contracts").orderBy("document_name", "contract_id")

    def citations(self, contract_id) -> DataFrame:
        """All citations of a contract; those that could not be verified are shown as such."""
        return self.of("citations").where(F.col("contract_id") == F.lit(contract_id)).orderBy("field_name", "page")

    def allocations(self) -> DataFrame:
        return self.of("allocations").orderBy(F.desc("amount"), "invoice_id", "payment_id")

    def reconciliation(self) -> DataFrame:
        """AGG12 of the invoices. No row says that nothing was reconciled, which is not the same as nothing found."""
        run = self.of("allocations").select("ws").limit(1)
        return review.settlement_export(self.of("invoices"), self.of("allocations"), self.of("claims")).join(F.broadcast(run), "ws", "left_semi")  # one row

    def revenue_summary(self) -> DataFrame:
        return revenue.state_totals(self.of("items"))

    def revenue_items(self) -> DataFrame:
        return self.of("items").orderBy(F.desc("recognised"), "item_id")

    # --- anomalies, critic, review ------------------------------------------------------------------------------------------------------------------------

    def anomalies(self) -> DataFrame:
        return self.of("anomalies").orderBy(rank(F.col("severity"), SEVERITIES), "rule", "anomaly_id")

    def precision(self) -> DataFrame:
        return anomaly.precision(self.of("anomalies"))

    def feedback(self, anomaly_id, is_false_positive: bool) -> DataFrame:
        """The anomalies with one reviewer's verdict in them."""
        this = (F.col("ws") == self.ws) & (F.col("anomaly_id") == F.lit(anomaly_id))
        return self.tables["anomalies"].withColumn("status", F.when(this, F.lit("DISMISSED" if is_false_positive else "CONFIRMED")).otherwise(F.col("status")))

    def critic(self) -> DataFrame:
        """Verdicts with their items, disputed ones first, then the largest."""
        items = self.of("items").select("ws", "item_id", "state", "recognised")
        return self.of("judgements").join(items, ["ws", "item_id"]).orderBy(rank(F.col("verdict"), VERDICTS), F.desc("recognised"), "item_id")

    def review(self, status: str = "open", limit: int | None = None) -> DataFrame:
        """Questions of a status (or "all"), each by its gravest and oldest item, with how many items ask it."""
        rows = self.of("review_items")
        rows = rows if status == "all" else rows.where(F.col("status") == status.upper())
        order = F.struct(rank(F.col("severity"), SEVERITIES).alias("rank"), F.coalesce("created_on", F.current_date()).alias("since"), "item_id")
        first = rows.withColumn("order", order).groupBy("question_key").agg(F.min("order").alias("order"), F.count("*").alias("members"), F.min_by(F.struct("category", "title", "severity", "status"), "order").alias("q"))
        return self._page("review", first.select("question_key", F.col("order.item_id").alias("item_id"), "q.*", "members", F.col("order.rank").alias("rank"), F.col("order.since").alias("since")), limit, "rank", "since", "item_id")

    def review_summary(self, now: Column) -> DataFrame:
        """One row: items by status, days of the oldest open one, and how many distinct questions wait."""
        rows = self.of("review_items")
        n = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
        waiting = F.col("status").isin("OPEN", "IN_PROGRESS")
        return rows.agg(
            n("OPEN"), n("IN_PROGRESS"), n("RESOLVED"), n("DISMISSED"), F.greatest(F.lit(0), F.datediff(now, F.min(F.when(F.col("status") == "OPEN", F.col("created_on"))))).alias("oldest_open_days"),
            F.countDistinct(F.when(waiting, F.col("question_key"))).alias("open_decisions"),
        )

    def waiting(self, by: str) -> DataFrame:
        """Items that wait, by category or severity."""
        return self.of("review_items").where(F.col("status").isin("OPEN", "IN_PROGRESS")).groupBy(by).agg(F.count("*").alias("n"))

    # --- room -----------------------------------------------------------------------------------------------------------------------------------------------

    def position(self) -> DataFrame:
        """FLT6 of the judged items."""
        return review.position(self.of("items").join(self.of("judgements").select("ws", "item_id", "is_published"), ["ws", "item_id"]))

    def trace(self, item_id) -> DataFrame:
        """JN16 of one item."""
        item = self.of("items").where(F.col("item_id") == F.lit(item_id))
        return review.trace(item, *(self.of(t) for t in ("contracts", "invoices", "allocations", "claims", "refunds")))

    def versions(self) -> DataFrame:
        return self.of("versions").orderBy(F.desc("version"))

    def changes(self, since: Column, limit: int | None = None) -> DataFrame:
        """Records whose content differs from what was held before: current, of a version beyond the first, and new since then."""
        rows = quality.current(self.of("raw_records")).where((F.col("version") > 1) & (F.col("created_at") >= since))
        return self._page("changes", rows, limit, F.desc("created_at"), "record_id")

    # --- evidence -------------------------------------------------------------------------------------------------------------------------------------------

    def evidence(self, record_type: str | None = None, limit: int | None = None) -> DataFrame:
        rows = quality.current(self.of("raw_records"))
        rows = rows.where(F.col("record_type") == record_type) if record_type else rows
        return self._page("evidence", rows, limit, F.desc("created_at"), "record_id")

    def evidence_counts(self) -> DataFrame:
        """AGG18"""
        return quality.current(self.of("raw_records")).groupBy("record_type", "source_system").agg(F.count("*").alias("n"))

    def lineage(self, source_id: str) -> DataFrame:
        """All versions of one source record, the oldest first."""
        rows = self.of("raw_records").where(F.col("source_id") == source_id)
        return rows.withColumn("superseded", F.col("superseded_by").isNotNull()).orderBy("version", "record_id")

    def _refused(self) -> DataFrame:
        return self.of("quarantined").where(F.col("resolved_at").isNull())

    def quarantine(self, limit: int | None = None) -> DataFrame:
        return self._page("quarantine", self._refused(), limit, F.desc("created_at"), "record_id")

    def quarantine_counts(self, by: str = "reason") -> DataFrame:
        """AGG17, by reason or by source_system."""
        return self._refused().groupBy(by).agg(F.count("*").alias("n"))

    def audit(self, limit: int | None = None) -> DataFrame:
        return self._page("audit", self.of("audit"), limit, F.desc("sequence"))

    def audit_integrity(self, parts: list[str]) -> DataFrame:
        """WIN9: the first broken row of the trail; no row if it is whole."""
        log = self.of("audit").withColumn("sequence", F.col("sequence") - 1)  # the trail counts from 1
        return quality.broken_links(log, ["ws"], "sequence", "event_hash", parts).withColumn("broken_at", F.col("broken_at") + 1)

    # --- front page -------------------------------------------------------------------------------------------------------------------------------------------

    def summary(self) -> DataFrame:
        """(name, n) of every table there is, then of the open reviews and what stays in quarantine."""
        counts = [self._count(t, self.of(t)) for t in COUNTED if t in self.tables]
        if "review_items" in self.tables:
            counts.append(self._count("open_review_items", self.of("review_items").where(F.col("status").isin("OPEN", "IN_PROGRESS"))))
        if "quarantined" in self.tables:
            counts.append(self._count("quarantined_records", self._refused()))
        out = counts[0]
        for more in counts[1:]:
            out = out.unionByName(more)
        return out

    @staticmethod
    def _count(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")

    def done(self) -> set[str]:
        """PIP2: the stages that have left their own marks. Rows that ingestion writes are none: an entity counts once it has a confidence, a contract once it was read."""
        marks = {
            "identity": ("entities", F.col("confidence").isNotNull()), "contracts": ("contracts", ~F.coalesce(F.array_contains("unknown_fields", UNREAD), F.lit(False))),
            "reconciliation": ("allocations", F.lit(True)), "revenue": ("items", F.lit(True)), "anomaly": ("anomalies", F.lit(True)),
            "review": ("judgements", F.lit(True)), "publish": ("versions", F.lit(True)),
        }
        found = {stage for stage, (table, mark) in marks.items() if table in self.tables and not self.of(table).where(mark).isEmpty()}
        return found - ({"reconciliation"} if "payments" not in self.tables or self.of("payments").isEmpty() else set())
