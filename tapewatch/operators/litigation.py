"""Dockets and matters: relevance, draft records, differences, refresh, validation, exploration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewatch.functions import text as texts
from tapewatch.functions.text import caption

#: Suit codes, and words that name a regulator, an exchange or a state as a party.
SUITS = ("850", "950")
REGULATORS = (
    "united states", "usa", "u.s.a", "cftc", "commodity futures trading commission", "sec", "securities and exchange commission",
    "gaming control board", "ngcb", "division of gaming", "gaming commission", "gaming enforcement", "gaming board",
)
EXCHANGES = ("event contract", "event contracts", "prediction market", "derivatives exchange", "designated contract market", "dcm")
STATE_PARTY = r"\b(state of|commonwealth of|people of the state|state's attorney)\b"
POSTURES = ("Enjoined", "Pending", "Permitted", "Settled", "Dismissed")
DECIDED = ("Permitted", "Enjoined", "Settled", "Dismissed")


def _any(text: Column, words) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if words else F.lit(False)


def relevance(dockets: DataFrame, targets: DataFrame) -> DataFrame:
    """``dockets`` with ``accept, platform, reason``. ``targets``: ``rank, platform, needle`` rows, the least rank that hits wins.

    The needles are a small dimension, so they travel as one array beside each docket: no pair is made.
    """
    needles = targets.agg(F.array_sort(F.collect_list(F.struct("rank", "needle", "platform"))).alias("_needles"))
    hay = F.lower(F.concat_ws(" || ", F.coalesce("case_name", F.lit("")), F.array_join(F.coalesce("party", F.array().cast("array<string>")), " || ")))
    rows = dockets.crossJoin(F.broadcast(needles)).withColumn("_hay", hay)
    hit = F.get(F.filter("_needles", lambda n: F.contains(F.col("_hay"), n["needle"])), F.lit(0))
    rows = rows.withColumn("_hit", hit)
    suit = F.substring(F.coalesce("suit_nature", F.lit("")), 1, 3)
    pair = _any(F.col("_hay"), REGULATORS) & (_any(F.col("_hay"), EXCHANGES) | F.exists("_needles", lambda n: F.contains(F.col("_hay"), n["needle"])) | F.col("_hay").rlike(STATE_PARTY))
    by_suit = suit.isin(*SUITS)
    accept = F.col("_hit").isNotNull() | (by_suit & pair)
    where = F.when(F.contains(F.lower(F.coalesce("case_name", F.lit(""))), F.col("_hit.needle")), "caption").otherwise("party")
    reason = (
        F.when(F.col("_hit").isNotNull(), F.concat(F.lit('target "'), F.col("_hit.needle"), F.lit('" in '), where)).when(by_suit & pair, F.concat(suit, F.lit(" companion")))
        .when(by_suit, F.concat(F.lit("nature-of-suit "), suit, F.lit(" without a pairing"))).otherwise("no target in caption or parties")
    )
    platform = F.when(F.col("_hit").isNotNull(), F.col("_hit.platform")).when(accept, "Other").otherwise("")
    return rows.withColumns({"accept": accept, "platform": platform, "reason": reason}).drop("_needles", "_hay", "_hit")


def slug(text: Column, words: int = 6) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "&", " and "), "[^a-z0-9]+", " "))
    stem = F.array_join(F.slice(F.split(clean, " +"), 1, words), "-")
    return F.when(stem == "", "matter").otherwise(stem)


def matter_id(name: Column, docket_id: Column) -> Column:
    return F.concat(slug(caption(name)), F.lit("-cl"), docket_id.cast("string"))


def docket_of(matter: Column) -> Column:
    """Docket number at the end of a matter's id, else null."""
    return F.regexp_extract(matter, r"-cl(\d+)$", 1).try_cast("long")


def docket_diff(dockets: DataFrame, matters: DataFrame, ledger: DataFrame) -> DataFrame:
    """``docket_id, id, action``: HELD, INSERT, UPSERT or SKIP for each classified docket, repeats of an id once.

    ``matters``: ``id, decided_date``; ``ledger``: ``docket_id`` seen before.
    """
    accepted = dockets.where("accept and docket_id is not null")
    one = accepted.groupBy("docket_id").agg(F.min(F.struct("case_name", "terminated")).alias("d")).select("docket_id", "d.*")
    known = matters.select(docket_of(F.col("id")).alias("docket_id"), F.col("id").alias("known"), "decided_date").where("docket_id is not null")
    joined = one.join(known, "docket_id", "left").join(ledger.select("docket_id", F.lit(True).alias("seen")).distinct(), "docket_id", "left")
    action = F.when(F.col("known").isNotNull(), F.when(F.col("terminated").isNotNull() & F.col("decided_date").isNull(), "UPSERT").otherwise("SKIP")).when(F.col("seen"), "SKIP").otherwise("INSERT")
    done = joined.select("docket_id", F.coalesce("known", matter_id(F.col("case_name"), F.col("docket_id"))).alias("id"), action.alias("action"))
    held = dockets.where("not accept or docket_id is null").select("docket_id", F.lit(None).cast("string").alias("id"), F.lit("HELD").alias("action"))
    return done.unionAll(held)


def refresh(matters: DataFrame, status: DataFrame, today: str) -> DataFrame:
    """``id, last_update, decided_date, flag_outcome``: what a docket's live dates change in its matter.

    ``status``: ``id, last_filing, modified, terminated``. Dates after ``today`` count as today.
    """
    day = F.lit(today).cast("date")
    clamp = lambda c: F.when(F.col(c).isNotNull(), F.least(F.col(c), day))
    joined = matters.join(status, "id")
    newest = F.greatest("filed_date", clamp("last_filing"), clamp("modified"))
    moved = newest.isNotNull() & (F.col("last_update").isNull() | (newest > F.col("last_update")) | (F.col("last_update") > day))
    decided = F.col("terminated").isNotNull() & F.col("decided_date").isNull()
    flag = F.col("terminated").isNotNull() & (F.col("outcome") == "Pending")
    return joined.select("id", F.when(moved, newest).otherwise(F.col("last_update")).alias("last_update"), F.when(decided, F.col("terminated")).otherwise(F.col("decided_date")).alias("decided_date"), F.coalesce(flag, F.lit(False)).alias("flag_outcome"))


@dataclass(frozen=True)
class MatterRules:
    enums: tuple = (("outcome", ("Permitted", "Enjoined", "Settled", "Dismissed", "Pending")),)
    required: tuple = ("id", "caption", "filed_date")
    states: tuple = ()
    arrays: tuple = ()
    parties: str | None = None


def problems(matters: DataFrame, rules: MatterRules = MatterRules()) -> DataFrame:
    """``id, problem``: each rule that a matter breaks. Ids are counted by one aggregation, joined to repeats only.

    ``states``: codes that the map has, if any are given; ``arrays``: columns that must be lists; ``parties``: a list of ``name, role``, each of
    which needs both. A column of another type than a list breaks its rule in every row.
    """
    broken = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in rules.required]
    broken += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.concat(F.lit(f"{c}: "), F.col(c))) for c, values in rules.enums]
    filed, decided = F.try_to_date("filed_date", "yyyy-MM-dd"), F.try_to_date("decided_date", "yyyy-MM-dd")
    broken += [F.when(F.col("filed_date").isNotNull() & filed.isNull(), F.lit("filed_date is no date")), F.when(F.col("decided_date").isNotNull() & decided.isNull(), F.lit("decided_date is no date")), F.when(decided < filed, F.lit("decided before filed"))]
    lists = {f.name for f in matters.schema if isinstance(f.dataType, T.ArrayType)}
    broken += [F.when(F.col(c).isNull(), F.lit(f"{c} must be a list")) if c in lists else F.lit(f"{c} must be a list") for c in rules.arrays]
    several = [F.array(*broken)]
    if rules.parties:
        empty = lambda c: F.coalesce(c, F.lit("")) == ""
        bad = lambda x, i: F.when(empty(x["name"]) | empty(x["role"]), F.concat(F.lit(f"{rules.parties}["), i.cast("string"), F.lit("] needs name and role")))
        several.append(F.coalesce(F.transform(rules.parties, bad), F.array().cast("array<string>")))
    if rules.states:
        off = F.filter("states", lambda s: ~F.coalesce(s.isin(*rules.states), F.lit(False)))
        several.append(F.coalesce(F.transform(off, lambda s: F.concat(F.lit("state "), F.coalesce(s, F.lit("null")), F.lit(" is not on the map"))), F.array().cast("array<string>")))
    own = matters.select("id", F.explode(F.filter(F.flatten(F.array(*several)), lambda x: x.isNotNull())).alias("problem"))
    repeats = matters.where(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    return own.unionAll(repeats)


def state_rollup(matters: DataFrame) -> DataFrame:
    """``state, n, posture``: matters of each state and the most pressing posture among them."""
    order = F.create_map(*(F.lit(x) for k, p in enumerate(POSTURES) for x in (p, k)))
    per = matters.select(F.explode("states").alias("state"), "posture").groupBy("state")
    return per.agg(F.count("*").alias("n"), F.min_by("posture", order[F.col("posture")]).alias("posture"))


def crosstab(matters: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts of ``rows`` x the given values of ``columns``; cells without matters are 0."""
    return matters.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).fillna(0, values)


def entity_degree(matters: DataFrame) -> DataFrame:
    """``kind, name, degree`` of platforms and forums."""
    return matters.groupBy(F.lit("platform").alias("kind"), F.col("platform").alias("name")).agg(F.count("*").alias("degree")).unionAll(matters.groupBy(F.lit("forum").alias("kind"), F.col("forum").alias("name")).agg(F.count("*").alias("degree")))


def search(matters: DataFrame, text: str = "", facets: dict[str, list[str]] | None = None, states: list[str] | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """Faceted search: a text in any described field, and all facets, states and years asked for."""
    found = matters
    if text:
        fields = [c for c in ("caption", "summary", "question", "platform") if c in matters.columns]
        found = found.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(text.lower())))
    for c, values in (facets or {}).items():
        found = found.where(F.col(c).isin(*values))
    if states:
        found = found.where(F.arrays_overlap("states", F.array(*map(F.lit, states))))
    if years:
        found = found.where(F.year(F.col("filed_date").cast("date")).between(*years))
    return found


#: Points for what a matter has in common with a scenario; a state counts twice in the vote.
ANALOG = {"contract": 3, "forum": 3, "state": 2, "gate": 2}


def analog_votes(scenarios: DataFrame, matters: DataFrame) -> DataFrame:
    """``scenario, matches, predicted``: matters scored against each scenario (contract 3, forum 3, state 2, gate 2).

    Matters are counted by what is scored first, and scenarios meet those counts by each value they share, so no pair
    without points is made. Votes of decided matters are summed by score, 2 more in the scenario's own state; ties by name.
    """
    keyed = matters.select("contract", "forum", "gate", "outcome", F.array_sort(F.array_distinct("states")).alias("states"))
    kinds = keyed.groupBy(*keyed.columns).agg(F.count("*").alias("n")).withColumn("kind", F.xxhash64("contract", "forum", "gate", "outcome", "states"))
    values = [("contract", F.array("contract")), ("forum", F.array("forum")), ("gate", F.array("gate")), ("state", F.col("states"))]

    def tagged(kind: str, column: Column) -> Column:
        return F.transform(column, lambda x: F.struct(F.lit(kind).alias("what"), x.alias("value")))

    have = kinds.select("kind", "outcome", "n", F.explode(F.concat(*(tagged(k, v) for k, v in values))).alias("h"))
    asked = scenarios.select("scenario", F.explode(F.array(*(F.struct(F.lit(k).alias("what"), F.col(k).alias("value")) for k in ANALOG))).alias("h"))
    points = F.create_map(*(F.lit(x) for pair in ANALOG.items() for x in pair))
    met = have.join(asked, "h").groupBy("scenario", "kind", "outcome", "n").agg(F.sum(points[F.col("h.what")] + F.when(F.col("h.what") == "state", 2).otherwise(0)).alias("votes"))
    per = met.groupBy("scenario", "outcome").agg(F.sum("n").alias("n"), F.sum(F.col("votes") * F.col("n")).alias("votes"))
    best = per.groupBy("scenario").agg(F.sum("n").alias("matches"), F.min(F.when(F.col("outcome").isin(*DECIDED), F.struct((-F.col("votes")).alias("v"), F.col("outcome").alias("o")))).alias("b"))
    return best.select("scenario", "matches", F.coalesce("b.o", F.lit("Unsettled")).alias("predicted"))


def tilt(matters: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts of each cell, and which way its decided matters lean: permitted, enjoined or even."""
    found = matters.groupBy(rows, columns).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "Permitted").alias("permitted"), F.count_if(F.col("outcome") == "Enjoined").alias("enjoined"))
    return found.withColumn("tilt", F.when(F.col("permitted") > F.col("enjoined"), "permitted").when(F.col("permitted") < F.col("enjoined"), "enjoined").otherwise("even"))


def entity_edges(matters: DataFrame) -> DataFrame:
    """``platform, forum, outcome, n``: edges of the entity graph by outcome."""
    return matters.groupBy("platform", "forum", "outcome").agg(F.count("*").alias("n"))


def doctrine_flow(matters: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """``gate, place, id, outcome``: matters of each gate (unknown ones are special) by outcome, then caption and id."""
    gate = F.when(F.col("gate").isin(*known), F.col("gate")).otherwise("special")
    rank = F.create_map(*(F.lit(x) for k, o in enumerate((*DECIDED, "Pending")) for x in (o, k)))
    w = Window.partitionBy("gate").orderBy(F.coalesce(rank[F.col("outcome")], F.lit(9)), "caption", "id", "filed_date")
    return matters.withColumn("gate", gate).withColumn("place", F.row_number().over(w)).select("gate", "place", "id", "outcome")


#: What a person must fill in for a draft, and what may stay a stub.
JUDGED = ("contractType", "gate", "doctrinalQuestion", "posture", "statutes", "summary")
STUBS = ("summary", "parties.role", "statutes", "doctrinalQuestion")


def drafts(dockets: DataFrame, courts: DataFrame, day: str) -> DataFrame:
    """``id, caption, platform, court, forum, states, filed_date, decided_date, summary, needs_review`` of classified dockets.

    ``courts``: ``court_id, state, label``, a dimension. Only what the docket itself says is filled in; all else is named in ``needs_review``.
    """
    rows = dockets.join(courts, "court_id", "left")
    name, known = caption(F.col("case_name")), F.col("label").isNotNull()
    label = F.coalesce("label", F.lower("court_id"), F.lit(""))
    review = F.concat(
        F.when(F.coalesce("platform", F.lit("")) == "", F.array(F.lit("platform"))).otherwise(F.array().cast("array<string>")), F.array(*map(F.lit, JUDGED)),
        F.when(known, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, ("courtForum", "forum", "states")))),
        F.when(F.size(F.coalesce("party", F.array().cast("array<string>"))) > 0, F.array(F.lit("parties.role"))).otherwise(F.array().cast("array<string>")),
    )
    states = F.when(F.coalesce("state", F.lit("")) != "", F.array("state")).otherwise(F.array().cast("array<string>"))
    return rows.select(
        matter_id(F.col("case_name"), F.col("docket_id")).alias("id"), name.alias("caption"), F.when(F.coalesce("platform", F.lit("")) == "", "Other").otherwise(F.col("platform")).alias("platform"), label.alias("court"),
        F.lit("Federal court").alias("forum"), states.alias("states"), F.col("filed").alias("filed_date"), F.col("terminated").alias("decided_date"), texts.stub_summary(label, F.col("number"), F.col("filed"), F.lit(day)).alias("summary"), review.alias("needs_review"),
    )


def approved(drafts_: DataFrame, allow_stub: bool = False) -> DataFrame:
    """Drafts that may be published: what is left to review is a stub at most."""
    return drafts_ if allow_stub else drafts_.where(F.forall("needs_review", lambda g: g.isin(*STUBS)))


def applied(matters: DataFrame, refreshed: DataFrame) -> DataFrame:
    """``matters`` with the two dates that a refresh (``id, last_update, decided_date``) may set; all that a person wrote stays."""
    new = refreshed.select(F.col("id").alias("_id"), F.col("last_update").alias("_last"), F.col("decided_date").alias("_decided"))
    rows = matters.join(new, matters["id"] == new["_id"], "left")
    return rows.withColumns({"last_update": F.coalesce("_last", "last_update"), "decided_date": F.coalesce("decided_date", "_decided")}).drop("_id", "_last", "_decided")


def press_rows(items: DataFrame) -> DataFrame:
    """``section, d, actors, sum, src, status, colour`` of press items (``title, link, day, description``) that are in scope."""
    body = F.concat_ws(" ", "title", "description")
    enforced, paid = texts.has_any(body, texts.ENFORCEMENT), texts.has_any(body, ("settl", "penalt"))
    rows = items.where(texts.has_any(body, texts.SCOPE))
    return rows.select(
        F.when(enforced, "enforcement").otherwise("regulatory").alias("section"), F.col("day").alias("d"), texts.actors(F.col("title")).alias("actors"), texts.cut_text(F.col("title"), 150).alias("sum"), F.col("link").alias("src"),
        F.when(~enforced, "Regulatory").when(paid, "Settled/penalty").otherwise("Charged").alias("status"), F.when(~enforced, "emerald").when(paid, "amber").otherwise("red").alias("colour"),
    )


#: Names that make a court docket one for the tracker, and the public bodies that bring such cases.
TRACKED = r"van dyke|spagnuolo"
PUBLIC_BODIES = r"commodity futures trading commission|cftc|united states"


def docket_rows(dockets: DataFrame) -> DataFrame:
    """Tracker rows of court dockets: a tracked name, or a public body against somebody in scope; each docket once."""
    parties = F.lower(F.array_join(F.coalesce("party", F.array().cast("array<string>")), " | "))
    name = F.lower(F.coalesce("case_name", F.lit("")))
    kept = dockets.where(F.concat(name, F.lit(" "), parties).rlike(TRACKED) | (parties.rlike(PUBLIC_BODIES) & texts.has_any(name, texts.SCOPE)))
    one = kept.groupBy(F.coalesce(F.col("docket_id").cast("string"), F.concat(F.lit("?"), name)).alias("key")).agg(F.min(F.struct("filed", "case_name", "number", "url")).alias("d")).select("d.*")
    said = F.concat(F.lit("Event-contract enforcement docket ("), F.coalesce("number", F.lit("verify")), F.lit("); details pending review."))
    return one.select(F.lit("enforcement").alias("section"), F.col("filed").alias("d"), texts.cut_text(F.col("case_name"), 60).alias("actors"), said.alias("sum"), F.col("url").alias("src"), F.lit("Charged").alias("status"), F.lit("red").alias("colour"))


def new_tracker_rows(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose key (docket, release or actors) the tracker hasn't; of rows that share a key the newest, ties by text."""
    key = lambda df: df.withColumn("key", texts.row_key(F.col("src"), F.col("actors")))
    rest = [c for c in rows.columns if c != "d"]
    best = key(rows).groupBy("key").agg(F.max(F.struct("d", *rest)).alias("b")).join(key(existing).select("key").distinct(), "key", "left_anti")
    return best.select("key", "b.*")


def tracker_order(rows: DataFrame, by: str = "newest") -> DataFrame:
    orders = {"newest": [F.desc("filed_date"), "id"], "oldest": [F.asc("filed_date"), "id"], "updated": [F.desc("last_update"), "id"], "name": ["caption", "id"]}
    return rows.orderBy(*orders[by])
