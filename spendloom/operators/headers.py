"""Which field a column header means. Headers are a handful of strings, so this is plain Python on the driver."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendloom.functions import columns as C
from spendloom.functions import fields

#: Canonical fields with spellings they are met under, lower case, words parted by one space.
FIELDS = {
    "invoice_date": ["invoice date", "inv date", "document date", "posting date", "rechnungsdatum", "date de facture", "fecha factura"],
    "po_document_date": ["po date", "order date", "purchase order date", "po document date"],
    "total_spend": ["total spend", "spend", "amount", "spend amount", "reporting spend", "invoice amount", "net amount", "betrag", "montant", "importe"],
    "local_spend": ["local spend", "amount in local currency", "local amount"],
    "currency": ["currency", "currency code", "curr", "waers", "local currency", "devise", "moneda", "währung"],
    "supplier": ["supplier", "supplier name", "vendor", "vendor name", "lifnr", "lieferant", "fournisseur", "proveedor"],
    "vendor_country": ["vendor country", "supplier country", "country", "land1", "land", "pays", "pais"],
    "region": ["region", "supplier region"],
    "plant": ["plant", "plant name", "site", "location", "facility", "werks"],
    "payment_terms": ["payment terms", "payment term", "terms of payment", "zterm", "zahlungsbedingungen"],
    "description": ["description", "item description", "material description", "short text", "txz01", "beschreibung"],
    "l1": ["l1", "category l1", "category level 1", "category"], "l2": ["l2", "category l2", "category level 2"], "l3": ["l3", "category l3", "category level 3"],
    "po_number": ["po number", "purchase order", "ebeln", "po no"], "quantity": ["quantity", "qty", "menge"], "unit_price": ["unit price", "price", "netpr"],
}
#: Standard fields that the list above lacks, under their names and spellings.
FIELDS |= {f: [n.lower() for n in (fields.FIELD_NAMES[f], *names)] for f, names in fields.FIELD_ALIASES.items() if f not in FIELDS and f not in ("country", "plant_name", "invoice_po_number", "price_per_uom")}
ABBREVIATIONS = fields.ABBREVIATIONS | {"cntry": "country", "pmt": "payment", "nr": "number"}
#: Shorter spellings are found within almost any header, so they count whole alone.
LEAST_PARTIAL = 4
JUNK = re.compile(r"^(unnamed.*|column ?\d*|field ?\d*|)$")
LEAST_FUZZY, LEAST_ROLE = 0.62, 0.75


@dataclass(frozen=True)
class Match:
    header: str
    field: str | None
    tier: str
    score: float


def plain(header: str) -> str:
    return re.sub(r"[\s_/\-]+", " ", header or "").strip().lower()


def split_camel(header: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", header or "")


def expanded(header: str) -> str:
    return " ".join(ABBREVIATIONS.get(w, w) for w in plain(split_camel(header)).split())


def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def partial(a: str, b: str) -> float:
    """Likeness of the shorter text to the stretch of the longer one that is most like it."""
    short, long = sorted((a, b), key=len)
    return max((_ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1)), default=0.0) if short else 0.0


def fuzzy(header: str, names: list[str]) -> float:
    """Likeness of a header to a field's name (the first) and its other spellings: characters, sorted words, shared words, and the best stretch."""
    best = 0.0
    for i, name in enumerate(names):
        a, b = {*header.split()}, {*name.split()}
        best = max(best, 0.7 * _ratio(header, name), 0.75 * _ratio(" ".join(sorted(a)), " ".join(sorted(b))), 0.7 * len(a & b) / max(len(a | b), 1))
        if min(len(header), len(name)) >= LEAST_PARTIAL:
            best = max(best, (0.85 if i else 0.8) * partial(header, name))
    return best * (0.7 if len(header) < 4 else 1.0)


def standard_match(columns: list[str]) -> dict[str, str]:
    """Standard field -> the first column whose header is its name or one of its spellings, in any case; of one spelling the first field counts."""
    known: dict[str, str] = {}
    for field, name in fields.FIELD_NAMES.items():
        for spelling in (name, *fields.FIELD_ALIASES[field]):
            known.setdefault(spelling.strip().lower(), field)
    found: dict[str, str] = {}
    for c in columns:
        if field := known.get(c.strip().lower()):
            found.setdefault(field, c)
    return found


def standard_table(df: DataFrame) -> DataFrame:
    """(field, shown, column, filled): every standard field, the column that holds it or null, and its rows with a value."""
    found = standard_match(df.columns)
    counts = df.agg(*(F.count(F.when(C.non_blank(c), 1)).alias(f) for f, c in found.items()), F.lit(1).alias("_one")).first()
    rows = [(f, shown, found.get(f), counts[f] if f in found else 0) for f, shown in fields.FIELD_NAMES.items()]
    return df.sparkSession.createDataFrame(rows, "field string, shown string, column string, filled long")


def hint(samples: list[str]) -> str | None:
    """A field that the values themselves give away."""
    values = [s.strip() for s in samples if s and s.strip()]
    share = lambda pattern: sum(bool(re.fullmatch(pattern, v)) for v in values) / len(values) if values else 0.0
    for field, pattern in (("currency", r"[A-Z]{3}"), ("payment_terms", r"(?i)(net|n)[\s\-_]*\d+|\d+\s*days?"), ("po_number", r"45\d{8}"), ("invoice_date", r"\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4}")):
        if share(pattern) >= 0.8:
            return field
    return None


def match_header(header: str, samples: list[str] = (), learned: dict[str, str] | None = None) -> Match:
    """Tiers in turn: junk, known spelling, split and expanded spelling, values, likeness, pending."""
    name, known = plain(header), {s: f for f, names in FIELDS.items() for s in (plain(f), *names)} | (learned or {})
    if JUNK.match(name):
        return Match(header, None, "drop", 1.0)
    for tier, spelling in (("alias", name), ("camel", plain(split_camel(header))), ("abbreviation", expanded(header))):
        if spelling in known:
            return Match(header, known[spelling], tier, 1.0)
    if field := hint([*samples]):
        return Match(header, field, "values", 0.8)
    score, field = max((fuzzy(expanded(header), [plain(f), *names]), f) for f, names in FIELDS.items())
    return Match(header, field, "fuzzy", round(score, 4)) if score >= LEAST_FUZZY else Match(header, None, "pending", round(score, 4))


def match_all(headers: list[str], samples: dict[str, list[str]] | None = None, learned: dict[str, str] | None = None) -> list[Match]:
    """Each field goes to its best header; the others stay pending."""
    found = [match_header(h, (samples or {}).get(h, []), learned) for h in headers]
    best: dict[str, int] = {}
    for i, m in enumerate(found):
        if m.field and (m.field not in best or m.score > found[best[m.field]].score):
            best[m.field] = i
    return [m if m.field is None or best[m.field] == i else Match(m.header, None, "pending", m.score) for i, m in enumerate(found)]


def match_table(df: DataFrame, values: int = 50, learned: dict[str, str] | None = None) -> DataFrame:
    """(header, field, tier, score, filled): what the columns of a table mean, by their headers and the values they hold.

    The hints come from each column's `values` commonest values, of equally common the least; filled
    counts its rows with a value. What reaches the driver is columns times values.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("header"), F.trim(C.text(C.column(c))).alias("v"), C.non_blank(C.column(c)).alias("given")) for c in df.columns))
    counted = df.select(F.explode(cells).alias("x")).where("x.given").groupBy("x.header", "x.v").agg(F.count("*").alias("n"))
    best = Window.partitionBy("header").orderBy(F.desc("n"), "v")
    filled = {r["header"]: r["n"] for r in counted.groupBy("header").agg(F.sum("n").alias("n")).collect()}
    samples: dict[str, list[str]] = {}
    for r in counted.withColumn("k", F.row_number().over(best)).where(F.col("k") <= values).orderBy("header", "k").collect():
        samples.setdefault(r["header"], []).append(r["v"])
    rows = [(m.header, m.field, m.tier, m.score, filled.get(m.header, 0)) for m in match_all(df.columns, samples, learned)]
    return df.sparkSession.createDataFrame(rows, "header string, field string, tier string, score double, filled long")


def resolve(available: list[str], role: str) -> list[str]:
    """Columns for a role: its own name, known spellings, then likeness of 0.75 or more."""
    names = [plain(role), *FIELDS.get(role, [])]
    exact = [c for c in available if plain(c) == names[0]]
    alias = [c for c in available if plain(c) in names[1:]]
    like = [c for c in available if max(difflib.SequenceMatcher(None, plain(c), n).ratio() for n in names) >= LEAST_ROLE]
    return [*dict.fromkeys([*exact, *alias, *like])]


def date_columns(available: list[str]) -> list[str]:
    return [*dict.fromkeys([*resolve(available, "invoice_date"), *resolve(available, "po_document_date"), *(c for c in available if "date" in c.lower())])]


def spend_column(available: list[str]) -> str | None:
    return next(iter([*resolve(available, "total_spend"), *resolve(available, "local_spend")]), None)


def learn(learned: dict[str, str], header: str, field: str, most: int = 75) -> dict[str, str]:
    """Add a spelling to the learned ones, at most 75 a field."""
    if field not in FIELDS:
        raise ValueError(f"unknown field {field}")
    return learned if sum(f == field for f in learned.values()) >= most else learned | {plain(header): field}


def apply_decisions(df: DataFrame, decisions: list[dict], learned: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(df under its approved headers, learned spellings).

    A decision has source_col, action (AUTO, REVIEW, DROP or KEEP), mapped_to, user_edited and
    custom_name. Dropped columns go, kept ones and those without a name stay as they are, the
    others are renamed. What a user set by hand for a known field is learned. Two columns of
    one new name are refused.
    """
    kept, learned = [], dict(learned or {})
    for d in decisions:
        source, action, target = d["source_col"], d.get("action", "KEEP"), (d.get("mapped_to") or "").strip()
        if action == "DROP":
            continue
        renamed = action != "KEEP" and bool(target)
        kept.append((source, target if renamed else source))
        if renamed and d.get("user_edited") and not d.get("custom_name") and target in FIELDS:
            learned = learn(learned, source, target)
    names = [n for _, n in kept]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"several columns would have one name: {sorted(n for n in names if names.count(n) > 1)}")
    return df.select(*(C.column(c).alias(n) for c, n in kept)), learned


def value_type(samples: list[str]) -> str:
    """date or numeric if at least half of the samples look like one, else text."""
    values = [s.strip() for s in samples]
    half = lambda pattern: 2 * sum(bool(re.fullmatch(pattern, v)) for v in values) >= len(values) > 0
    if half(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}.*|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}.*"):
        return "date"
    return "numeric" if half(r"[+-]?[\d,]*\.?\d+") else "text"


def currency_code_column(spend: str | None, available: list[str]) -> str | None:
    """The column with the codes of a spend column in local currency: the one paired with it, else one of a known spelling."""
    paired = {plain(k): v for k, v in fields.CODE_OF_SPEND.items()}.get(plain(spend or ""))
    if paired is None:
        return None
    names = [plain(paired), *map(plain, FIELDS["currency"])]
    return min((c for c in available if plain(c) in names), key=lambda c: names.index(plain(c)), default=None)


def decision_sheet(df: DataFrame, decisions: list[dict], most: int = 50) -> list[list[str]]:
    """Rows of a sheet to edit: actions, targets, headers, then at most `most` rows of the table, which a preview is."""
    heads = [[d.get("action", "KEEP") for d in decisions], [d.get("mapped_to") or "" for d in decisions], [d["source_col"] for d in decisions]]
    rows = df.select(*(C.text(C.column(d["source_col"])).alias(f"c{i}") for i, d in enumerate(decisions))).limit(most).collect()
    return [*heads, *(["" if v is None else v for v in r] for r in rows)]


def sheet_decisions(rows: list[list[str | None]]) -> list[dict]:
    """Decisions of an edited sheet; cells without a header are left out, actions that are not known keep the column."""
    at = lambda row, i: ((rows[row][i] if row < len(rows) and i < len(rows[row]) else None) or "").strip()
    found = []
    for i in range(max(map(len, rows[:3]), default=0)):
        action = at(0, i).upper()
        if source := at(2, i):
            found.append({"source_col": source, "action": action if action in ("AUTO", "REVIEW", "KEEP", "DROP") else "KEEP", "mapped_to": at(1, i) or None})
    return found
