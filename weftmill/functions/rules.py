"""Rule functions: topics, types, lifecycle decisions, states. Tables of values are fixed by the data model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftmill.functions.text import is_topic, normalize_topic, slugify, word

# Ordered subject patterns (first wins) and the topic of each.
TOPICS = (
    (r"sommerseminar|sommer\s*seminar", "internal/events"),
    (r"summer\s*school|conference|workshop|retreat|meetup", "internal/events"),
    (r"group\s*reporting|groupreporting", "sap/consolidation/group-reporting"),
    (r"bcs|business\s*consolidation\s*system", "sap/consolidation/bcs"),
    (r"ndc\s*financial\s*consolidation", "sap/consolidation/ndc-financial-consolidation"),
    (r"bpc|bw\s*planning", "sap/planning/bpc"),
    (r"datasphere", "sap/business-warehouse/datasphere"),
    (r"bw/4|business\s*warehouse", "sap/business-warehouse/bw"),
    (r"btp|business\s*technology\s*platform", "sap/cloud/btp"),
    (r"bdc", "sap/cloud/bdc"),
    (r"sac", "sap/reporting/sac"),
    (r"lumira", "sap/reporting/lumira"),
    (r"bex|wad", "sap/reporting/legacy"),
    (r"abap", "sap/development/abap"),
    (r"cds", "sap/development/cds"),
    (r"fiori|ui5", "sap/development/fiori"),
    (r"esg", "sap/esg"),
    (r"s/?4hana", "sap/migration/s4hana"),
    (r"consolidation", "sap/consolidation"),
)

# Ordered patterns of document types (first wins), default concept.
TYPES = (
    (r"sommerseminar|conference|workshop|retreat|meetup|summer\s*school|agenda|itinerary", "event"),
    (r"paper|arxiv|doi|publication|official\s*(?:documentation|docs?|guide)|help\.sap\.com|vendor\s*(?:material|documentation|docs?)|published\s*by", "source"),
    (r"meeting\s*minutes|attendees?|action\s*items?|discussion\s*points", "minute"),
    (r"annual\s*report|financial\s*report|project\s*status|quarterly\s*report|audit\s*report|income\s*statement|balance\s*sheet|profit|revenue|findings|overview", "report"),
    (r"how\s*to|runbook|step\s*-?\s*by\s*-?\s*step|operating\s*guide|user\s*guide|manual|handbook|troubleshoot", "manual"),
    (r"specification|requirements|architecture|interface|config(?:uration)?|schema|data\s*model", "spec"),
    (r"proposal|implementation\s*plan|roadmap|offering|scope\s*of\s*work|statement\s*of\s*work|quotation", "proposal"),
    (r"contract|agreement|n\s*d\s*a|partnership|procurement|terms\s*and\s*conditions", "contract"),
    (r"policy|regulation|sop|code\s*of\s*conduct|compliance", "policy"),
    (r"presentation|slides|slide\s*deck|deck|training\s*material|talk", "presentation"),
    (r"employee\s*profile|profile\s*of|curriculum\s*vitae|cv|biography", "person"),
    (r"company|corporation|inc\.?|gmbh|dataset|project|product|client", "entity"),
)

# Document types and the folder of each.
TYPE_DIRS = {
    "report": "reports", "minute": "minutes", "spec": "specs", "manual": "manuals", "proposal": "proposals", "contract": "contracts", "policy": "policies",
    "presentation": "presentations", "event": "events", "source": "sources", "person": "people", "entity": "entities", "concept": "concepts", "code": "code",
}

# State machines as (from, to, transition, actor).
TICKET_EDGES = (
    ("backlog", "in_progress", "claim", "worker"), ("in_progress", "done", "report-done", "worker"), ("in_progress", "in_review", "report-in_review", "worker"),
    ("done", "in_review", "report-in_review", "worker"), ("in_review", "approved", "approve", "reviewer"), ("in_review", "rejected", "reject", "reviewer"),
)
SPEC_EDGES = (
    ("backlog", "in_progress", "start", "eng-director"), ("in_progress", "done", "report-done", "eng-director"), ("done", "in_review", "report-in_review", "eng-director"), ("in_review", "approved", "approve", "reviewer"),
    ("in_review", "rejected", "reject", "reviewer"), ("rejected", "backlog", "re-decompose", "eng-director"), ("rejected", "in_progress", "re-decompose", "eng-director"),
)
STATUSES = ("backlog", "in_progress", "done", "in_review", "approved", "rejected", "canceled")
COLUMNS = {"backlog": "Backlog", "in_progress": "In Progress", "done": "Done", "in_review": "In Review", "approved": "Approved", "rejected": "Rejected", "canceled": "Canceled"}


def ordered_match(c: Column, rules: tuple[tuple[str, str], ...], default: str | None = None) -> Column:
    """The value of the first rule whose pattern occurs between word borders."""
    return F.coalesce(*[F.when(c.rlike(word(p)), v) for p, v in rules], F.lit(default))


def haystack(title: Column, content: Column) -> Column:
    return F.lower(F.concat(title, F.lit("\n"), content))


def local_topic(title: Column, content: Column) -> Column:
    return ordered_match(haystack(title, content), TOPICS)


def local_type(title: Column, content: Column) -> Column:
    return ordered_match(haystack(title, content), TYPES, "concept")


def type_dir(c: Column) -> Column:
    return lookup(c, TYPE_DIRS)


def lookup(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def classify(kind: Column, topic: Column, title: Column, content: Column) -> Column:
    """A given type and topic where they are valid, else the local ones; and the page path."""
    category = F.when(kind.isin(*TYPE_DIRS), kind).otherwise(local_type(title, content))
    chosen = F.when(is_topic(topic), topic).otherwise(local_topic(title, content))
    return F.struct(category.alias("category"), chosen.alias("topic"), F.concat(F.lit("wiki/"), type_dir(category), F.lit("/"), slugify(title), F.lit(".md")).alias("page_path"))


def days_between(a: Column, b: Column) -> Column:
    """Whole days, never negative; 0 if a date is missing or invalid."""
    return F.coalesce(F.greatest(F.lit(0), F.datediff(F.try_to_timestamp(b), F.try_to_timestamp(a))), F.lit(0))


def round3(c: Column) -> Column:
    return F.floor(c * 1000 + 0.5) / 1000


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def review(confidence: Column, reads: Column, updated: Column, now: Column, topic: Column, retopic: Column, kind: Column, reclassify: Column, reinforce: Column, decay: float = 0.001, stale_days: int = 180, archive_reads: int = 3, archive_at: float = 0.3, boost: float = 0.15) -> Column:
    """The lifecycle decision of a page; precedence: retopic, reclassify, deprecate, reinforce, fade."""
    age = days_between(updated, now)
    faded = clamp(confidence - age * decay)
    new_topic = normalize_topic(F.when(is_topic(retopic), retopic))
    moves = new_topic.isNotNull() & ~new_topic.eqNullSafe(topic)
    wanted = F.lower(F.trim(reclassify))
    retypes = wanted.isin(*TYPE_DIRS) & ~wanted.eqNullSafe(kind)
    moves, retypes = F.coalesce(moves, F.lit(False)), F.coalesce(retypes, F.lit(False))
    rots = (age >= stale_days) & (reads < archive_reads)
    halved = clamp(faded * 0.5)
    action = F.when(moves, "retopic").when(retypes, "reclassify").when(rots, "deprecate").when(reinforce, "reinforce").when(faded < confidence - 1e-9, "deprecate").otherwise("none")
    value = F.when(moves | retypes, faded).when(rots, halved).when(reinforce, clamp(faded + boost)).otherwise(faded)
    return F.struct(action.alias("action"), round3(value).alias("confidence"), round3(value - confidence).alias("delta"), (~moves & ~retypes & rots & (halved <= archive_at)).alias("archive"))


def adjust_confidence(c: Column, direction: Column, step: float = 0.15) -> Column:
    return round3(clamp(c + F.when(direction == "up", step).otherwise(-step)))


def reachability(registered: Column, last_seen: Column, invited: Column, now: Column, seconds: int = 300) -> Column:
    """unknown, invited, registered or reachable."""
    fresh = last_seen.isNotNull() & (F.unix_timestamp(now) - F.unix_timestamp(last_seen) <= seconds)
    return F.when(registered & fresh, "reachable").when(registered, "registered").when(invited, "invited").otherwise("unknown")


def overall_progress(parsing: Column, refining: Column, wiki: Column, graph: Column) -> Column:
    """The decision table over four stage states."""
    stopped = lambda c, otherwise: F.when(c == "failed", 100).otherwise(otherwise)
    return (
        F.when(parsing != "done", stopped(parsing, 15)).when(refining != "done", stopped(refining, 35)).when((wiki == "done") & (graph == "done"), 100)
        .when(wiki == "done", stopped(graph, 88)).when(graph == "done", stopped(wiki, 72)).when((wiki == "failed") | (graph == "failed"), 100).otherwise(50)
    )


def ui5_kind(path: Column) -> Column:
    """The unit kind of a source path; null for excluded folders and other files."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(path.rlike(r"(^|/)(node_modules|dist|coverage|test|tests|__tests__)(/|$)"), F.lit(None)).otherwise(
        F.when(base.rlike(r"controller\.(js|ts)$"), "controller").when(base.rlike(r"\.(view|fragment)\.xml$"), "view").when(base == "manifest.json", "manifest")
        .when(base.rlike(r"\.model\.json$"), "model").when(base.isin("component.js", "component.ts"), "component").when(base.rlike(r"\.(js|ts|jsx|tsx|xml|json)$"), "js")
    )


def data_category(name: Column, annotations: Column, sources: Column) -> Column:
    """Transaction or master data by name, annotations and source tables; unknown otherwise."""

    def any_of(*parts: str) -> Column:
        return reduce(lambda a, b: a | b, [F.upper(name).contains(x) for x in parts])

    return (
        F.when(any_of("ITEM", "POSTING", "DOCUMENT", "TRANSACTION", "AMOUNT", "BALANCE", "JOURNAL"), "Transaction Data")
        .when(F.lower(annotations).contains("#t") | F.lower(sources).contains("t"), "Transaction Data")
        .when(any_of("GROUP", "COMPANY", "CODE", "HIERARCHY", "TEXT", "MASTER", "FSITEM", "SUBITEM", "ENTITY"), "Master Data").otherwise("unknown")
    )


def code_topic(system: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(system)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(F.coalesce(F.trim(system), F.lit("")) != "", F.concat(F.lit("code/"), s)).otherwise("code/unknown")
