"""Ingest into a ledger with duplicate decisions that depend on the order of arrival.

A new row is compared with the entries of its scope and lane that are in the ledger when it
arrives, new ones included, in the order of the index:

* an incident among ``character_topics`` is skipped only for an entry that looks like an incident,
  is 0.6 alike, comes from the same chat and lies within five turns;
* in ``user_topics`` the first entry that is 0.35 alike decides: if it says the same but for a few
  content words, the new row is created and supersedes it, and it leaves the ledger; else the new
  row is skipped;
* anything else is skipped for the first entry that is 0.35 alike.

Alike is a summary with the new summary, or with the new content if that is longer than 20 characters.

What is alike is found once for all scopes by a join of token sets. Entries that hang together by
that are a component; only components with at least two rows are replayed in order, from rows of
numbers without texts. Components share no set, so a task replays many of them at once. Copies are taken out before: of equal rows in a lane
without corrections the first one decides, and of a run of equal rows in a lane with corrections
only so many can be anything but skipped as rows came before them.

Defined cases: a row whose summary is blank is left out (action ``blank``); null content is empty;
a null chat or turn is never the same moment; ties of ``pos`` are broken by ``id``, which is unique
in a scope; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convmem.functions import text as X
from convmem.operators import setjoin
from convmem.operators.graph import checkpoint, components


@dataclass(frozen=True)
class Rules:
    """Lanes with a rule of their own, and what alike means in them."""

    incident_lane: str = "character_topics"
    correction_lane: str = "user_topics"
    least: float = 0.35
    least_incident: float = 0.6
    turns: int = 5
    content_chars: int = 20
    fact_kind: str = "trait"


#: Explicit commands: what a row is does not matter, and nothing is corrected.
REMEMBER = Rules(incident_lane="", correction_lane="")
COLUMNS = ("scope_id", "lane", "kind", "id", "pos", "summary", "content", "source_chat_id", "turn_start")


def _bag(text: Column) -> Column:
    return F.array_sort(X.bag(text))


def _rows(ledger: DataFrame, incoming: DataFrame, rules: Rules) -> DataFrame:
    """Ledger and new rows with the blocks they are compared in and their token sets.

    Family ``a`` compares by lane, family ``b`` incidents of a chat. A row probes in one of them
    if it is new, and may be a target in both.
    """
    both = ledger.select(*COLUMNS).withColumn("is_new", F.lit(False)).unionByName(incoming.select(*COLUMNS).where(F.trim("summary") != "").withColumn("is_new", F.lit(True)))
    incident = (F.col("lane") == rules.incident_lane) & F.coalesce(F.col("kind") == "incident", F.lit(False)) & F.col("is_new")
    looks = (F.col("lane") == rules.incident_lane) & X.looks_incident(F.col("summary")) & F.col("source_chat_id").isNotNull()
    content = F.trim(F.coalesce("content", F.lit("")))
    by_lane, by_chat = F.to_json(F.array(F.lit("a"), "scope_id", "lane")), F.to_json(F.array(F.lit("b"), "scope_id", F.col("source_chat_id").cast("string")))
    return both.select(
        "scope_id", "lane", "id", "pos", "is_new", incident.alias("incident"), (F.col("lane") == rules.correction_lane).alias("corrects"), F.col("turn_start").cast("bigint").alias("turn"),
        _bag(F.trim("summary")).alias("summary"), F.when(F.col("is_new") & (F.length(content) > rules.content_chars), _bag(content)).alias("content"),
        by_lane.alias("block_a"), F.when(looks | (incident & F.col("source_chat_id").isNotNull()), by_chat).alias("block_b"), looks.alias("target_b"),
    )


def _sets(rows: DataFrame) -> DataFrame:
    new_a, new_b = F.col("is_new") & ~F.col("incident"), F.col("incident")
    no = F.lit(False)
    parts = [
        rows.select(F.col("block_a").alias("block"), F.col("summary").alias("t"), new_a.alias("probe"), F.lit(True).alias("target")),
        rows.where(new_a & F.col("content").isNotNull()).select(F.col("block_a").alias("block"), F.col("content").alias("t"), F.lit(True).alias("probe"), no.alias("target")),
        rows.where("block_b is not null").select(F.col("block_b").alias("block"), F.col("summary").alias("t"), new_b.alias("probe"), F.col("target_b").alias("target")),
        rows.where(new_b & F.col("content").isNotNull() & F.col("block_b").isNotNull()).select(F.col("block_b").alias("block"), F.col("content").alias("t"), F.lit(True).alias("probe"), no.alias("target")),
    ]
    return setjoin.numbered_sets(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))


def _digest(block: Column, words: Column) -> Column:
    """A set of a block in 32 bytes, so that its words need not be sent to meet its number; words have no blanks."""
    return F.when(block.isNotNull() & words.isNotNull(), F.unhex(F.sha2(F.concat_ws("\n", block, F.array_join(words, " ")), 256)))


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Numbers of a row's sets in place of its words."""
    slots = (("sa", "block_a", "summary"), ("ca", "block_a", "content"), ("sb", "block_b", "summary"), ("cb", "block_b", "content"))
    known = checkpoint(sets.select(_digest(F.col("block"), F.col("t")).alias("key"), "set_id"))
    probing_a, probing_b = F.col("is_new") & ~F.col("incident"), F.col("incident")
    keys = {name: _digest(F.col(block), F.col(words)) for name, block, words in slots}
    keys |= {"ca": F.when(probing_a, keys["ca"]), "cb": F.when(probing_b, keys["cb"])}
    rows = rows.withColumns({f"k{name}": key for name, key in keys.items()}).drop("summary", "content", "block_a", "block_b")
    for name, _, _ in slots:
        rows = rows.join(known.select(F.col("key").alias(f"k{name}"), F.col("set_id").alias(name)), f"k{name}", "left").drop(f"k{name}")
    return rows


#: From so many words in a set, on average, most candidates that a prefix gives have nothing to do with each other, and their words would be sent with each.
LONG = 50


def _alike(sets: DataFrame, rules: Rules) -> DataFrame:
    """(a, b, similarity): as ``setjoin.similar``; whole texts are compared in tiles."""
    least = F.when(F.startswith("block", F.lit('["a"')), rules.least).otherwise(rules.least_incident)
    if (sets.agg(F.avg(F.size("t"))).first()[0] or 0) < LONG:
        return setjoin.similar(sets, least)
    found = setjoin.similar_in_tiles(sets.select("block", "set_id", "t"), min(rules.least, rules.least_incident))
    side = lambda c: sets.select(F.col("set_id").alias(c), F.col("probe").alias(f"p{c}"), F.col("target").alias(f"t{c}"), *[least.alias("least")] * (c == "a"))
    found = checkpoint(found.join(side("a"), "a").join(side("b"), "b").where(F.col("similarity") >= F.col("least") - 1e-12))
    one, other = found.where("pa and tb").select("a", "b", "similarity"), found.where("pb and ta").select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")
    itself = sets.where("probe and target").select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.lit(1.0).alias("similarity"))
    return one.unionByName(other).unionByName(itself)


def _edges(sets: DataFrame, rules: Rules) -> DataFrame:
    """(a, b, correction): a probing set and a target set that are alike enough in their family."""
    found = _alike(sets, rules)
    side = lambda n: sets.select(F.col("set_id").alias(n), F.col("t").alias(f"t{n}"))
    close = found.where("similarity >= 0.5 and a <> b").join(side("a"), "a").join(side("b"), "b").where(X.correction(F.col("ta"), F.col("tb"))).select("a", "b", F.lit(True).alias("correction"))
    return found.join(close, ["a", "b"], "left").select("a", "b", F.coalesce("correction", F.lit(False)).alias("correction"))


def _replay(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Decisions of whole components, in order. Sets belong to one component, so rows of another one never meet."""
    near: dict[int, list[int]] = {}
    corrections = set()
    for a, b, c in edges.itertuples(index=False):
        near.setdefault(a, []).append(b)
        if c:
            corrections.add((a, b))
    present: dict[int, dict[int, tuple]] = {}
    out = []
    rows = rows.sort_values(["is_new", "pos", "id"], kind="stable")
    for at, r in enumerate(rows.itertuples(index=False)):
        action, against = "existing", None
        if r.is_new:
            own, content = (r.sb, r.cb) if r.incident else (r.sa, r.ca)
            hit = None
            for probe in (own, content):
                for b in near.get(probe, ()) if probe >= 0 else ():
                    for order, e in present.get(b, {}).items():
                        if hit is not None and order > hit[0]:
                            break
                        if not r.incident or abs(e[1] - r.turn) <= r.turns:
                            hit = (order, e[0], b)
                            break
            if hit is None:
                action = "created"
            elif r.corrects and (own, hit[2]) in corrections:
                action, against = "corrected", hit[1]
                present[hit[2]].pop(hit[0])
            else:
                action, against = "skipped", hit[1]
        if action != "skipped":
            for s in {r.sa, r.sb if r.target_b else -1} - {-1}:
                present.setdefault(s, {})[at] = (r.id, r.turn)
        out.append((r.scope_id, r.id, action, against))
    return pd.DataFrame(out, columns=["scope_id", "id", "action", "against"])


def decisions(ledger: DataFrame, incoming: DataFrame, rules: Rules = Rules(), rows_per_part: int = 20_000) -> DataFrame:  # noqa: B008
    """(scope_id, id, action, against) of every new row: ``created``, ``corrected`` (created, ``against`` is superseded), ``skipped`` (because of ``against``) or ``blank``."""
    if incoming.isEmpty():
        return incoming.select("scope_id", "id", F.lit(None).cast("string").alias("action"), F.col("id").alias("against"))
    rows = checkpoint(_rows(ledger, incoming, rules))
    sets = _sets(rows)
    numbered = checkpoint(_with_sets(rows, sets))
    edges = checkpoint(_edges(sets, rules))

    # Sets that can decide anything: alike to another set, or of several rows.
    owners = numbered.select("scope_id", "id", F.explode(F.array_compact(F.array("sa", "ca", "sb", "cb"))).alias("set_id")).distinct()
    several = owners.groupBy("set_id").agg(F.count("*").alias("n")).where("n > 1").select("set_id")
    links = edges.where("a <> b").select("a", "b")
    active = links.select(F.col("a").alias("set_id")).unionByName(links.select(F.col("b").alias("set_id"))).unionByName(several).distinct()
    held = checkpoint(owners.join(active, "set_id"))
    first = held.groupBy("scope_id", "id").agg(F.min("set_id").alias("a"))
    together = held.join(first, ["scope_id", "id"]).select("a", F.col("set_id").alias("b")).where("a <> b").distinct()
    roots = checkpoint(active.join(components(links.unionByName(together)), F.col("set_id") == F.col("node"), "left").select("set_id", F.coalesce("component", "set_id").alias("component")))

    part = checkpoint(numbered.join(first.join(roots, F.col("a") == F.col("set_id")).select("scope_id", "id", "component"), ["scope_id", "id"], "left"))
    kind_of = dict(part.dtypes)
    nothing = F.lit(None).cast(kind_of["id"]).alias("against")
    alone = part.where("component is null and is_new").select("scope_id", "id", F.lit("created").alias("action"), nothing)

    # Copies: all but the first of equal rows, or the ends of runs of them.
    same = [F.coalesce(c, F.lit(-1)) for c in ("sa", "ca", "sb", "cb")]
    moment = F.when(F.col("target_b") | F.col("incident"), F.when(F.col("sb").isNull() | F.col("turn").isNull(), F.concat(F.lit("?"), "id")).otherwise(F.col("turn").cast("string")))
    kind = F.xxhash64(*same, "is_new")
    order = [F.col("is_new"), F.col("pos"), F.col("id")]
    ahead = Window.partitionBy("component").orderBy(*order)
    own = Window.partitionBy("component", *same, moment, "is_new", "incident", "target_b").orderBy(*order)
    joined = part.where("component is not null")
    plain = joined.where("not corrects").withColumn("rep", F.first("id").over(own))
    runs = joined.where("corrects").withColumn("n", F.row_number().over(ahead)).withColumn("new_run", F.when(F.lag(kind).over(ahead) == kind, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new_run").over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("component", "run").orderBy("n")
    runs = runs.withColumn("before", F.first("n").over(in_run) - 1).withColumn("in_run", F.row_number().over(in_run))
    kept_id = F.when(~F.col("is_new") | (F.col("in_run") <= F.col("before") + 2), F.col("id"))
    runs = runs.withColumn("rep", F.last(kept_id, ignorenulls=True).over(in_run.rowsBetween(Window.unboundedPreceding, 0)))
    every = checkpoint(plain.unionByName(runs.drop("n", "new_run", "run", "before", "in_run")))

    replayed = every.where("rep = id").select(
        "component", "scope_id", "id", "pos", "is_new", "incident", "corrects", "target_b", F.coalesce("turn", F.lit(-(1 << 40)) - F.col("pos") * 100).alias("turn"), F.lit(rules.turns).alias("turns"), *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("sa", "ca", "sb", "cb")]
    )
    by_component = edges.join(roots, F.col("a") == F.col("set_id")).select("component", "a", "b", "correction")
    schema = f"scope_id {kind_of['scope_id']}, id {kind_of['id']}, action string, against {kind_of['id']}"
    # Parts of components by a hash, each of bounded size but for a component that is larger itself; a group of its own for each would cost more than its replay.
    n = max(every.sparkSession.sparkContext.defaultParallelism, every.count() // rows_per_part, edges.count() // (20 * rows_per_part)) + 1
    deal = lambda rows: rows.withColumn("part", F.pmod(F.xxhash64("component"), F.lit(n)).cast("int")).drop("component").repartition(n, "part")
    decided = checkpoint(deal(replayed).groupBy("part").cogroup(deal(by_component).groupBy("part")).applyInPandas(lambda r, e: _replay(r.drop(columns="part"), e.drop(columns="part")), schema))

    of_rep = decided.select("scope_id", F.col("id").alias("rep"), F.col("action").alias("act"), F.col("against").alias("because"))
    copies = every.where("is_new and rep <> id").join(of_rep, ["scope_id", "rep"]).select("scope_id", "id", F.lit("skipped").alias("action"), F.when(F.col("act") == "skipped", F.col("because")).otherwise(F.col("rep")).alias("against"))
    blank = incoming.where(F.coalesce(F.trim("summary"), F.lit("")) == "").select("scope_id", "id", F.lit("blank").alias("action"), nothing)
    return decided.where("action <> 'existing'").unionByName(alone).unionByName(copies).unionByName(blank)


def created(incoming: DataFrame, decided: DataFrame) -> DataFrame:
    """The new rows that become entries."""
    return incoming.join(decided.where("action in ('created', 'corrected')").select("scope_id", "id"), ["scope_id", "id"])


def supersessions(ledger: DataFrame, incoming: DataFrame, decided: DataFrame) -> DataFrame:
    """(scope_id, existing_id, existing_summary, new_id, new_summary): what a correction replaces."""
    texts = ledger.select("scope_id", "id", "summary").unionByName(incoming.select("scope_id", "id", "summary"))
    old = texts.select("scope_id", F.col("id").alias("against"), F.col("summary").alias("existing_summary"))
    pairs = decided.where("action = 'corrected'").join(old, ["scope_id", "against"]).join(incoming.select("scope_id", "id", F.trim("summary").alias("new_summary")), ["scope_id", "id"])
    return pairs.select("scope_id", F.col("against").alias("existing_id"), "existing_summary", F.col("id").alias("new_id"), "new_summary")


def tasks(incoming: DataFrame, decided: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(scope_id, lane, id, summary, against_id): skipped facts, which a curator may see otherwise. Incidents and threads are no facts."""
    fact = (F.col("lane") == rules.correction_lane) | ((F.col("lane") == rules.incident_lane) & (F.col("kind") == rules.fact_kind))
    return incoming.where(fact).join(decided.where("action = 'skipped'").select("scope_id", "id", F.col("against").alias("against_id")), ["scope_id", "id"]).select("scope_id", "lane", "id", F.trim("summary").alias("summary"), "against_id")


def applied(ledger: DataFrame, incoming: DataFrame, decided: DataFrame) -> DataFrame:
    """The ledger afterwards: its rows and the created ones, with ``superseded_by`` where one was replaced."""
    pairs = decided.where("action = 'corrected'").select("scope_id", F.col("against").alias("id"), F.col("id").alias("superseded_by"))
    rows = ledger.select(*COLUMNS).unionByName(created(incoming, decided).select(*COLUMNS))
    return rows.join(pairs, ["scope_id", "id"], "left")
