"""Customer identity: strong signals, components within a company, and signals shared between companies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.operators.components import connected_components
from leadflow.plans.session import materialise

# Fixed values of the data contract.
DUMMY_EMAILS = (
    "test@test.com", "test@example.com", "test@example.org", "example@example.com", "noemail@noemail.com",
    "no@no.com", "none@none.com", "null@null.com", "n/a@n/a.com",
)
DUMMY_PREFIXES = ("test@", "prueba@", "noemail@")


def valid_email(c):
    ok = c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & ~F.lower(c).isin(*DUMMY_EMAILS)
    for p in DUMMY_PREFIXES:
        ok = ok & ~F.lower(c).startswith(p)
    return ok


KINDS = ("PHONE", "EMAIL", "SOURCE_LEAD_ID")


def lead_values(leads: DataFrame) -> DataFrame:
    """{raw_row_id, lead_id, empresa_id, canal_normalizado, PHONE, EMAIL, SOURCE_LEAD_ID}: what identifies a lead, in one row. [raw_row_id]

    E-mails come without regard to a missing company, as the contract has it; they link nobody then."""
    there = F.col("empresa_id").isNotNull()
    return leads.select(
        "raw_row_id", "lead_id", "empresa_id", "canal_normalizado",
        F.when(there & (F.col("telefono_parse_status") == "VALID"), F.col("telefono_normalizado")).alias("PHONE"),
        F.when(valid_email(F.col("email_normalizado")), F.col("email_normalizado")).alias("EMAIL"),
        F.when(there, F.nullif(F.trim("lead_id"), F.lit(""))).alias("SOURCE_LEAD_ID"),
    )


def value_signals(values: DataFrame) -> DataFrame:
    """lead_values -> {raw_row_id, lead_id, empresa_id, signal_type, signal_value}, a row for each value of a row."""
    kinds = F.array(*[F.struct(F.lit(k).alias("signal_type"), F.col(k).alias("signal_value")) for k in KINDS])
    base = ["raw_row_id", "lead_id", "empresa_id"]
    return values.select(*base, F.explode(kinds).alias("s")).select(*base, "s.*").where("signal_value is not null")


def identity_signals(leads: DataFrame) -> DataFrame:
    """Distinct {raw_row_id, lead_id, empresa_id, signal_type, signal_value}: source id, phone and e-mail of each lead."""
    return value_signals(lead_values(leads)).distinct()


KEY = ["empresa_id", "signal_type", "signal_value"]


def _own(signals: DataFrame) -> DataFrame:
    return signals.where("empresa_id is not null").select("raw_row_id", "lead_id", *KEY)


def signal_holders(signals: DataFrame) -> DataFrame:
    """{empresa_id, signal_type, signal_value, raw_row_id}: each value's smallest row. Rows that share a value are linked through it,
    so a value of n leads costs n links."""
    return _own(signals).groupBy(*KEY).agg(F.min("raw_row_id").alias("raw_row_id"))


def identity_components(signals: DataFrame) -> DataFrame:
    """{raw_row_id, component_key}: leads of a company that share signals, directly or through others; the key is the smallest row."""
    own = _own(signals)
    hubs = own.groupBy(*KEY).agg(F.min("raw_row_id").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = connected_components(own.join(hubs, KEY).select("u", F.col("raw_row_id").alias("v")))
    rows = own.select("raw_row_id").distinct().join(found.withColumnRenamed("node", "raw_row_id"), "raw_row_id", "left")
    return rows.select("raw_row_id", F.coalesce("component", "raw_row_id").alias("component_key"))


def component_rows(components: DataFrame, values: DataFrame) -> DataFrame:
    """lead_values of the leads that have a component: {raw_row_id, lead_id, empresa_id, component_key, canal_normalizado, held}."""
    each = [F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("signal_type"), F.col(k).alias("signal_value"))) for k in KINDS]
    own = values.where("empresa_id is not null").join(components.select("raw_row_id", "component_key"), "raw_row_id")
    return own.select("raw_row_id", "lead_id", "empresa_id", "component_key", "canal_normalizado", F.array_compact(F.array(*each)).alias("held"))


def told_components(rows: DataFrame, flat: bool = False) -> DataFrame:
    """component_rows -> what is told of each component: its id, counts and evidence. [component_key, empresa_id]

    The id is a hash of the company and the component's smallest phone, else e-mail, else source id. Values are hashed
    once they have been put together, as hashes are longer than what they stand for. With `flat`, the evidence is text
    (signal_types, signals), so that the text of a large component is made once and not in each of its rows."""
    held = F.array_distinct(F.flatten(F.collect_list("held")))
    told = rows.groupBy("component_key", "empresa_id").agg(
        held.alias("held"), F.count("*").alias("identity_member_count"), F.size(F.collect_set("lead_id")).alias("ids"), F.size(F.collect_set("canal_normalizado")).alias("channels"),
    )
    smallest = lambda kind: F.array_min(F.transform(F.filter("held", lambda s: s["signal_type"] == kind), lambda s: s["signal_value"]))
    types = F.array_sort(F.array_distinct(F.transform("held", lambda s: s["signal_type"])))
    signals = F.array_sort(F.transform("held", lambda s: F.struct(F.md5(s["signal_value"]).alias("value_hash"), s["signal_type"].alias("signal_type"))))
    if flat:
        evidence = [F.array_join(types, ",").alias("signal_types"), F.array_join(F.transform(signals, lambda s: F.concat_ws(":", s["value_hash"], s["signal_type"])), ",").alias("signals")]
    else:
        evidence = [F.struct(types.alias("signal_types"), signals.alias("signals")).alias("identity_evidence")]
    n = F.col("identity_member_count")
    return told.select(
        "component_key", "empresa_id", F.concat(F.lit("CID_"), F.md5(F.concat_ws("|", "empresa_id", F.coalesce(*[smallest(k) for k in KINDS])))).alias("customer_identity_id"),
        n, (n > 1).alias("is_duplicate_identity"), (n > F.col("ids")).alias("is_source_duplicate"), (F.col("channels") > 1).alias("has_multiple_channels"), *evidence,
    )


def tell_rows(rows: DataFrame, told: DataFrame) -> DataFrame:
    """{raw_row_id, lead_id, ..} of component_rows with what is told of their component. [raw_row_id]"""
    out = rows.select("raw_row_id", "lead_id", "empresa_id", "component_key").join(told, ["component_key", "empresa_id"])
    return out.select("raw_row_id", "lead_id", *[c for c in told.columns if c != "component_key"])


def describe_components(components: DataFrame, leads: DataFrame, signals: DataFrame) -> DataFrame:
    """The identity of each lead of `components`, of which a lead may have several signals of a type. [raw_row_id]"""
    held = _own(signals).groupBy("raw_row_id", "empresa_id").agg(F.collect_set(F.struct("signal_type", "signal_value")).alias("held"))
    rows = held.join(components.select("raw_row_id", "component_key"), "raw_row_id").join(leads.select("raw_row_id", "lead_id", "canal_normalizado"), "raw_row_id")
    return tell_rows(rows, told_components(rows))


def lead_identity_map(leads: DataFrame, signals: DataFrame) -> DataFrame:
    """Identity of each lead that has a signal in a company. [raw_row_id]"""
    return describe_components(materialise(identity_components(signals), "identity-components"), leads, signals)


def map_of_values(values: DataFrame, flat: bool = False) -> DataFrame:
    """lead_identity_map from lead_values, which are read again and again: a table. [raw_row_id]"""
    rows = component_rows(materialise(identity_components(value_signals(values)), "identity-components"), values)
    return tell_rows(rows, told_components(rows, flat))


def grow_components(known: DataFrame, holders: DataFrame, new_signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A day's signals against what is known: (added {raw_row_id, component_key}, moved {component_key, to}).

    known {raw_row_id, component_key} and holders (signal_holders of all signals so far) are only looked up: known components
    are single nodes, and edges are those of the day. added has the day's rows, moved the known components that the day
    has joined to a smaller key; of every other row nothing changes. All but the look-ups costs what the day costs.
    A row that was known before may come again with more signals.
    """
    day = materialise(_own(new_signals), "identity-day")
    first = day.groupBy(*KEY).agg(F.min("raw_row_id").alias("first"))
    seen = first.join(holders.withColumnRenamed("raw_row_id", "holder"), KEY, "left")
    hub = known.select(F.col("raw_row_id").alias("holder"), F.col("component_key").alias("held_by"))
    hubs = seen.join(hub, "holder", "left").select(*KEY, F.coalesce("held_by", "first").alias("hub"))
    rows = day.select("raw_row_id").distinct().join(known, "raw_row_id", "left").select("raw_row_id", F.coalesce("component_key", "raw_row_id").alias("node"))
    rows = materialise(rows, "identity-rows")
    edges = day.join(hubs, KEY).join(rows, "raw_row_id").select(F.col("hub").alias("u"), F.col("node").alias("v")).where("u != v")
    found = materialise(connected_components(edges), "identity-moves")
    added = rows.join(found, "node", "left").select("raw_row_id", F.coalesce("component", "node").alias("component_key"))
    touched = hubs.select(F.col("hub").alias("node")).unionByName(rows.select("node")).distinct()
    old = touched.join(known.select(F.col("component_key").alias("node")).distinct(), "node", "left_semi")
    moved = old.join(found.where("node != component"), "node").select(F.col("node").alias("component_key"), F.col("component").alias("to"))
    return added, moved


def extend_components(known: DataFrame, added: DataFrame, moved: DataFrame) -> DataFrame:
    """known with a day's rows and moves."""
    kept = known.join(added.select("raw_row_id"), "raw_row_id", "left_anti").join(moved, "component_key", "left")
    return kept.select("raw_row_id", F.coalesce("to", "component_key").alias("component_key")).unionByName(added)


def touched_components(components: DataFrame, added: DataFrame) -> DataFrame:
    """Of `components`, the day included, those that have one of the day's rows."""
    return materialise(components.join(added.select("component_key").distinct(), "component_key", "left_semi"), "identity-touched")


def extend_identity_map(components: DataFrame, added: DataFrame, leads: DataFrame, signals: DataFrame) -> DataFrame:
    """The rows of the map that a day changes or adds: those of every component that has one of the day's rows. `components`,
    `leads` and `signals` include the day; the rows of other components are what they were, so these are to be upserted."""
    rows = touched_components(components, added)
    own = rows.select("raw_row_id")
    return describe_components(rows, leads.join(own, "raw_row_id", "left_semi"), signals.join(own, "raw_row_id", "left_semi"))


def customer_identity(identity: DataFrame, leads: DataFrame) -> DataFrame:
    """One row per customer: members, distinct ids, phones, e-mails and channels, and their sorted lists."""
    seen = identity.join(leads.select("raw_row_id", "telefono_normalizado", "email_normalizado", "canal_normalizado"), "raw_row_id")
    return seen.groupBy("customer_identity_id", "empresa_id").agg(
        F.count("*").alias("member_count"), F.countDistinct("lead_id").alias("lead_id_count"), F.countDistinct("telefono_normalizado").alias("phone_count"),
        F.countDistinct("email_normalizado").alias("email_count"), F.countDistinct("canal_normalizado").alias("channel_count"),
        F.max("is_source_duplicate").alias("has_source_duplicate"), F.array_sort(F.collect_set("lead_id")).alias("lead_ids"),
        F.array_sort(F.collect_set("canal_normalizado")).alias("channels"), F.min_by("identity_evidence", "raw_row_id").alias("identity_evidence"),
    )


def cross_company_signals(signals: DataFrame) -> DataFrame:
    """Phones and e-mails that several companies hold: hashed, counted, never merged."""
    groups = signals.where("signal_type in ('PHONE', 'EMAIL') and empresa_id is not null").groupBy("signal_type", "signal_value")
    found = groups.agg(F.countDistinct("empresa_id").alias("company_count"), F.countDistinct("raw_row_id").alias("lead_count")).where("company_count > 1")
    return found.select("signal_type", F.md5("signal_value").alias("signal_value_hash"), "company_count", "lead_count")
