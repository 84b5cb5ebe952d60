"""Nested case documents into flat tables that keep their parent-child links.

A top-down tree automaton reads each document. Its table, ``AUTOMATON``, says for a state and the shape of a value
(its JSON type and which telling members an object has) what the value is: a list whose elements take another
state, text to be read again as JSON, or a node of a variant, whose members take states of their own. Values
whose state and shape have no rule are rejected. Every variant is routed to its own typed subtype table; all
tables share the supertype keys, which are the positions of the node's ancestors and its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread


@dataclass(frozen=True)
class Rule:
    """What a value of one shape in one state is."""

    #: State of each element (a list), of the value itself as the one element (``alone``), or of the text read as JSON.
    each: str | None = None
    alone: str | None = None
    again: str | None = None
    #: Table and variant of a node; the states of its members; which key its position fills.
    table: str | None = None
    variant: str | None = None
    members: dict[str, str] = field(default_factory=dict)
    #: A node that stands for its parent too: it keeps position 0 under itself.
    own_list: bool = False


def _lists(state: str, element: str) -> dict[tuple[str, str], Rule]:
    """A list may be written as an array, as its only object, or as JSON text of either."""
    unread, read = state, f"{state} as read"
    rules = {(s, "array"): Rule(each=element) for s in (unread, read)} | {(s, "object"): Rule(alone=element) for s in (unread, read)}
    return rules | {(unread, "text"): Rule(again=read)}


#: Members whose presence, or whose value's type, tells shapes of objects in a state apart.
TELLING = {"case": ("has", "media"), "exif": ("type", "propertyvalue")}
AUTOMATON: dict[tuple[str, str], Rule] = {
    ("document", "object"): Rule(members={"value": "cases"}),
    **_lists("cases", "case"),
    ("case", "object with media"): Rule(table="case", variant="case", members={"media": "media"}),
    ("case", "object without media"): Rule(table="media", variant="bare", members={"exifs": "exifs"}, own_list=True),
    **_lists("media", "record"),
    ("record", "object"): Rule(table="media", variant="listed", members={"exifs": "exifs"}),
    **_lists("exifs", "exif"),
    **{("exif", f"object of {kind}"): Rule(table="exif", variant=kind) for kind in ("text", "number", "flag", "array", "object", "null")},
}
#: Columns of the typed tables and the members they come from.
CASE_MEMBERS = {"case_id": "caseid", "case_number": "casenumber", "application": "sourceapplicationname"}
MEDIA_MEMBERS = {"media_key": "mediaid", "md5": "md5", "sha1": "sha1", "category": "category", "media_size": "mediasize", "rel_path": "relativefilepath", "mime": "mimetype"}
_BLANK = " \t\r\n\f\v\x00\u00a0"

_JSON_TYPES = {str: "text", bool: "flag", int: "number", float: "number", list: "array", dict: "object", type(None): "null"}
KEYS = ("raw_id", "case_pos", "media_pos", "exif_pos")
NODES = "raw_id long, node string, variant string, case_pos int, media_pos int, exif_pos int, prop string, prop_value string, fields map<string,string>"


def _text(v: object) -> str | None:
    """A scalar as text; structures as compact JSON."""
    if v is None or isinstance(v, str):
        return v
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def _members(o: dict) -> dict:
    """Members by lower-case name; of names that differ in case only, the first."""
    low: dict = {}
    for k, v in o.items():
        low.setdefault(k.lower(), v)
    return low


def _parse(text: str) -> object:
    try:
        return json.loads(text.removeprefix("\ufeff"))
    except (ValueError, RecursionError):
        return None


def shape_of(state: str, v: object) -> str:
    """The symbol the automaton reads: JSON type, and of objects in a telling state what tells them apart."""
    kind = _JSON_TYPES[type(v)]
    if kind != "object" or state not in TELLING:
        return kind
    how, member = TELLING[state]
    if how == "has":
        return f"object {'with' if member in v else 'without'} {member}"
    return f"object of {_JSON_TYPES[type(v.get(member))]}"


def walk(state: str, v: object, path: tuple[int, ...] = ()) -> Iterator[tuple[Rule, tuple[int, ...], dict]]:
    """Nodes below a value: (rule, positions, members), parents first."""
    if isinstance(v, dict):
        v = _members(v)
    rule = AUTOMATON.get((state, shape_of(state, v)))
    if rule is None:
        return
    if rule.again:
        yield from walk(rule.again, _parse(v), path)
    elif rule.each or rule.alone:
        for i, e in enumerate(v) if rule.each else [(0, v)]:
            yield from walk(rule.each or rule.alone, e, (*path, i))
    else:
        path = (*path, 0) if rule.own_list else path
        if rule.table:
            yield rule, path, v
        for member, child in rule.members.items():
            if member in v:
                yield from walk(child, v[member], path)


def _pick(members: dict, wanted: dict[str, str]) -> dict[str, str | None]:
    return {k: _text(members.get(m)) for k, m in wanted.items() if members.get(m) is not None}


def read_document(raw_id: int, body: str | None, tables: tuple[str, ...]) -> Iterator[tuple]:
    """The nodes of one document that go to ``tables``, each with its variant and the positions of its ancestors."""
    root = _parse(body) if body else None
    if not isinstance(root, dict):
        return
    for rule, path, members in walk("document", root):
        if rule.table not in tables:
            continue
        keys = (*path, None, None)[:3]
        if rule.table == "exif":
            name = members.get("propertyname")
            prop = name.strip(_BLANK).strip() if isinstance(name, str) else ""
            if prop:
                yield raw_id, "exif", rule.variant, *keys, prop, _text(members.get("propertyvalue")), None
        else:
            yield raw_id, rule.table, rule.variant, *keys, None, None, _pick(members, CASE_MEMBERS if rule.table == "case" else MEDIA_MEMBERS)


_COLUMNS = ["raw_id", "node", "variant", "case_pos", "media_pos", "exif_pos", "prop", "prop_value", "fields"]
_BATCH = 20_000


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    for c in ("case_pos", "media_pos", "exif_pos"):
        out[c] = out[c].astype("Int32")
    return out


def shred(raw: DataFrame, tables: tuple[str, ...] = ("case", "media", "exif")) -> DataFrame:
    """Every node of every document, one row each, with keys (raw_id, case_pos, media_pos, exif_pos).

    ``raw`` has ``raw_id`` and ``body``; other columns are ignored. Bodies that are null, not JSON or not one
    object give no rows. Documents are read one at a time and rows leave in bounded batches, so a document of
    any number of records needs only its own memory. Repeated documents give repeated rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for raw_id, body in zip(batch["raw_id"], batch["body"]):
                for row in read_document(raw_id, body, tables):
                    rows.append(row)
                    if len(rows) >= _BATCH:
                        yield _frame(rows)
                        rows = []
        if rows:
            yield _frame(rows)

    return spread(raw.select("raw_id", "body").where(F.col("raw_id").isNotNull() & F.col("body").isNotNull())).mapInPandas(run, NODES)


#: SQL of the typed column of every Exif variant.
_EXIF = {"text": "prop_value", "number": "try_cast(prop_value AS double)", "flag": "try_cast(prop_value AS boolean)", "array": "prop_value", "object": "prop_value", "null": "cast(null AS string)"}


def _members_of(wanted: dict[str, str]) -> dict[str, str]:
    return {k: f"fields['{k}']" for k in wanted}


#: (table, variant) -> (number of supertype keys, typed columns and their SQL).
SUBTYPES: dict[tuple[str, str], tuple[int, dict[str, str]]] = {
    ("case", "case"): (2, _members_of(CASE_MEMBERS)),
    **{("media", v): (3, _members_of(MEDIA_MEMBERS)) for v in ("listed", "bare")},
    **{("exif", v): (4, {"prop": "prop", "value": c}) for v, c in _EXIF.items()},
}


class VariantTables:
    """The subtype tables of a table of documents, and per node kind the supertype over all its variants.

    Nodes are told apart in one pass; ``keep`` writes them to the shared checkpoint folder first, for a
    consumer that reads several tables. Repeated documents count once.
    """

    def __init__(self, raw: DataFrame, tables: tuple[str, ...] = ("case", "media", "exif"), keep: bool = False) -> None:
        nodes = shred(raw, tables)
        self.nodes = cut(nodes) if keep else nodes

    def subtype(self, table: str, variant: str) -> DataFrame:
        """The supertype keys and the typed columns of one variant."""
        n, columns = SUBTYPES[table, variant]
        rows = self.nodes.where((F.col("node") == table) & (F.col("variant") == variant))
        return rows.select(*KEYS[:n], *[F.expr(c).alias(k) for k, c in columns.items()]).distinct()

    def subtypes(self) -> dict[str, DataFrame]:
        """Every subtype table, named table_variant."""
        return {f"{t}_{v}": self.subtype(t, v) for t, v in SUBTYPES}

    def supertype(self, table: str, *columns: Column) -> DataFrame:
        """The common keys of all variants of a table, and such columns as all of them have."""
        n = next(n for (t, _), (n, _) in SUBTYPES.items() if t == table)
        return self.nodes.where(F.col("node") == table).select(*KEYS[:n], *columns).distinct()


def case_table(raw: DataFrame) -> DataFrame:
    """One row per case object that owns a Media member."""
    return VariantTables(raw, ("case",)).subtype("case", "case")


def media_table(raw: DataFrame) -> DataFrame:
    """One row per media record, ``variant`` telling listed records from bare ones."""
    columns = [F.expr(c).alias(k) for k, c in _members_of(MEDIA_MEMBERS).items()]
    return VariantTables(raw, ("media",)).supertype("media", F.col("variant"), *columns)


def exif_table(raw: DataFrame) -> DataFrame:
    """One row per Exif object with a non-blank name; ``variant`` is the type of its value, with a column for each."""
    typed = [F.when(F.col("variant") == v, F.expr(_EXIF[v])).alias(f"value_{v}") for v in ("text", "number", "flag")]
    whole = F.when(F.col("variant").isin("array", "object"), F.col("prop_value")).alias("value_json")
    return VariantTables(raw, ("exif",)).supertype("exif", F.col("prop"), F.col("variant"), *typed, whole)
