"""Review of entities: a log of decisions, edits of texts, and undo and redo."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps that undo remembers.
MEMORY = 50


def final_state(entities: DataFrame, log: DataFrame, keys: tuple[str, ...] = ("doc_id", "entity_id")) -> DataFrame:
    """entities with accepted as the last decision of the log (keys, seq, accepted) left it."""
    last = log.groupBy(*keys).agg(F.max_by("accepted", "seq").alias("__last"))
    return entities.join(last, list(keys), "left").withColumn("accepted", F.coalesce("__last", "accepted")).drop("__last")


def toggle(entities: DataFrame, log: DataFrame, keys: tuple[str, ...] = ("doc_id", "entity_id")) -> DataFrame:
    """entities flipped once for each row of the log."""
    odd = log.groupBy(*keys).agg((F.count("*") % 2 == 1).alias("__odd"))
    return entities.join(odd, list(keys), "left").withColumn("accepted", F.col("accepted") != F.coalesce("__odd", F.lit(False))).drop("__odd")


def set_category(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """entities accepted by a table (category, accepted); categories that it lacks count as accepted."""
    return entities.join(rules.withColumnRenamed("accepted", "__rule"), "category", "left").withColumn("accepted", F.coalesce("__rule", F.lit(True))).drop("__rule")


def edit_text(entities: DataFrame, edits: DataFrame, keys: tuple[str, ...] = ("doc_id", "entity_id")) -> DataFrame:
    """entities with the text of the last edit (keys, seq, text); spans stay."""
    last = edits.groupBy(*keys).agg(F.max_by("text", "seq").alias("__text"))
    return entities.join(last, list(keys), "left").withColumn("text", F.coalesce("__text", "text")).drop("__text")


def replay(entities: DataFrame, actions: DataFrame) -> DataFrame:
    """(doc_id, entity_id, accepted) after the actions (doc_id, seq, action, target, accepted) of each document in order.

    Actions: toggle (target: entity), accept_all, reject_all, group (target: entity ids joined by commas), category
    (target: category), undo, redo. A new action that changes or may change something clears redo; undo and redo each
    record what they overwrite; both stacks hold the last 50 steps.
    """

    def run(key: tuple, ents: pd.DataFrame, acts: pd.DataFrame) -> pd.DataFrame:
        state = dict(zip(ents["entity_id"], ents["accepted"], strict=True))
        category = dict(zip(ents["entity_id"], ents["category"], strict=True))
        undo: list[dict] = []
        redo: list[dict] = []
        for a in acts.sort_values("seq").itertuples():
            if a.action in ("undo", "redo"):
                source, other = (undo, redo) if a.action == "undo" else (redo, undo)
                if source:
                    change = source.pop()
                    other.append({k: state[k] for k in change if k in state})
                    del other[:-MEMORY]
                    state |= {k: v for k, v in change.items() if k in state}
                continue
            wanted = {"toggle": lambda a=a: {a.target: not state[a.target]} if a.target in state else {}, "accept_all": lambda: dict.fromkeys(state, True), "reject_all": lambda: dict.fromkeys(state, False), "group": lambda a=a: {k: bool(a.accepted) for k in str(a.target).split(",") if k in state}, "category": lambda a=a: {k: bool(a.accepted) for k in state if category[k] == a.target}}[a.action]()
            change = {k: state[k] for k, v in wanted.items() if state[k] != v}
            state |= wanted
            if change:
                undo.append(change)
                del undo[:-MEMORY]
                redo.clear()
        return pd.DataFrame({"doc_id": [key[0]] * len(state), "entity_id": list(state), "accepted": [bool(x) for x in state.values()]})

    kind = entities.schema["doc_id"].dataType.simpleString()
    return entities.select("doc_id", "entity_id", "category", "accepted").groupBy("doc_id").cogroup(actions.groupBy("doc_id")).applyInPandas(run, f"doc_id {kind}, entity_id string, accepted boolean")


def numbered(entities: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """entities with ord, their place by start in each document."""
    return entities.withColumn("ord", F.row_number().over(Window.partitionBy(doc_id).orderBy("start_pos", "end_pos")) - 1)


