"""Column functions for cleaning text, phones, numbers, flags and money. All stay in the JVM but the two Unicode forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# Fixed values of the data contract.
FOLDED_FROM, FOLDED_TO = "ÁÉÍÓÚÜÑáéíóúüñ", "AEIOUUNaeiouun"
CHANNELS = {"whatsapp": "whatsapp", "meta ads": "meta_ads", "formulario web": "formulario_web"}
STATES = {
    "sin gestion": "sin_gestion", "contactado": "contactado", "no contesta": "no_contesta",
    "cotizacion enviada": "cotizacion_enviada", "en proceso": "en_proceso", "descartado": "descartado",
}
CITIES = {
    "bogota": "bogota", "bogota d.c.": "bogota", "bogota dc": "bogota", "medellin": "medellin", "rio negro": "rionegro", "rionegro": "rionegro",
    "b/quilla": "barranquilla", "barranquilla": "barranquilla", "sta marta": "santa_marta", "santa marta": "santa_marta", "bello": "bello",
    "cartagena": "cartagena", "cartagena de indias": "cartagena", "itagui": "itagui", "monteria": "monteria", "soacha": "soacha", "soledad": "soledad",
}
OUTCOMES = {"cerrado": True, "perdido": False}
MONEY_WORDS = r"\$|cop|pesos?|millones?|palos?|mil|presupuesto|plata|dinero|inicial|entrada|enganche|cuota"
ERROR_RULES = (
    ("output_length_limit", ("length limit was reached", "maximum completion tokens", "max_completion_tokens", "max tokens", "finish_reason=length", '"finish_reason": "length"')),
    ("rate_limit", ("429", "rate limit", "too many requests")),
    ("request_timeout", ("timeout", "timed out")),
    ("model_unavailable", ("404", "not found")),
    ("request_error", ("connection", "connecterror", "apierror", "status code: 5")),
)


def _mapped(value: Column, table: dict) -> Column:
    """value looked up in a small fixed table (a literal map, so value is computed once); null where it isn't there."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[value]


def normalize_text(c: Column) -> Column:
    """Fold the 14 accented letters of the contract, collapse white space, trim, lower-case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(c, FOLDED_FROM, FOLDED_TO), r"\s+", " ")))


def normalize_lexical(c: Column) -> Column:
    """normalize_text with every run of other signs as one space."""
    return F.trim(F.regexp_replace(normalize_text(c), "[^a-z0-9]+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def channel(c: Column) -> Column:
    return _mapped(normalize_text(c), CHANNELS)


def management_state(c: Column) -> Column:
    return _mapped(normalize_text(c), STATES)


def city(c: Column) -> Column:
    return _mapped(normalize_text(c), CITIES)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def phone_normalized(c: Column) -> Column:
    """+57 and ten digits for a mobile number with no, a short or a long country prefix; else null."""
    number = F.regexp_extract(_digits(c), "^(?:57|0057)?(3[0-9]{9})$", 1)
    return F.when(number != "", F.concat(F.lit("+57"), number))


def phone_status(c: Column) -> Column:
    return F.when(c.isNull(), "MISSING").when(_digits(c).rlike("^(57|0057)?3[0-9]{9}$"), "VALID").otherwise("INVALID")


def profile_phone(c: Column) -> Column:
    """Profiling form: as phone_normalized, but the bare digits where it isn't a mobile number."""
    d = _digits(c)
    local = F.when(d.startswith("0057") & (F.length(d) == 14), F.substring(d, 5, 10)).when(d.startswith("57") & (F.length(d) == 12), F.substring(d, 3, 10)).otherwise(d)
    return F.when(local.rlike("^3[0-9]{9}$"), F.concat(F.lit("+57"), local)).otherwise(local)


def profile_city(c: Column) -> Column:
    """Profiling form: without points; an alias, or the value itself."""
    v = F.replace(normalize_text(c), F.lit("."), F.lit(""))
    aliases = {"bogota dc": "bogota", "bogota d c": "bogota", "cartagena de indias": "cartagena", "rio negro": "rionegro", "sta marta": "santa marta", "b/quilla": "barranquilla"}
    return F.coalesce(_mapped(v, aliases), v)


def profile_model(c: Column) -> Column:
    """Profiling form: lexical, without the word 2026."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_lexical(c), r"\b2026\b", ""), r"\s+", " "))


def safe_integer(c: Column) -> Column:
    return F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c)).try_cast("int")


def safe_decimal(c: Column) -> Column:
    """Digits with an optional decimal part (the evident intent of the contract), else null."""
    return F.when(F.trim(c).rlike(r"^[0-9]+(\.[0-9]+)?$"), F.trim(c)).try_cast("decimal(38,6)")


def number_status(c: Column, decimal: bool = False) -> Column:
    pattern = r"^[0-9]+(\.[0-9]+)?$" if decimal else "^[0-9]+$"
    return F.when(F.trim(c).rlike(pattern), "VALID").when(blank_to_null(c).isNull(), "MISSING").otherwise("INVALID")


def yes_no(c: Column) -> Column:
    return _mapped(normalize_text(c), {"si": True, "no": False})


def yes_no_status(c: Column) -> Column:
    return F.when(c.isNull(), "MISSING").when(normalize_text(c).isin("si", "no"), "VALID").otherwise("INVALID")


def is_closed(c: Column) -> Column:
    return _mapped(normalize_text(c), OUTCOMES)


def canonical_model(brand: Column, line: Column) -> Column:
    return F.when(blank_to_null(brand).isNotNull() & blank_to_null(line).isNotNull(), F.concat_ws(" ", F.trim(brand), F.trim(line)))


def strip_nul(c: Column) -> Column:
    return F.replace(c, F.lit("\u0000"), F.lit(""))


def without_nul(df: DataFrame) -> DataFrame:
    """df without NUL characters in any text, however deep in structs, arrays and values of maps; keys, names and other types stay."""

    def clean(c: Column, kind: DataType) -> Column:
        if isinstance(kind, StringType):
            return strip_nul(c)
        if isinstance(kind, ArrayType) and holds_text(kind):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, MapType) and holds_text(kind.valueType):
            return F.transform_values(c, lambda _, v: clean(v, kind.valueType))
        if isinstance(kind, StructType) and holds_text(kind):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    def holds_text(kind: DataType) -> bool:
        if isinstance(kind, ArrayType):
            return holds_text(kind.elementType)
        if isinstance(kind, MapType):
            return holds_text(kind.valueType)
        if isinstance(kind, StructType):
            return any(holds_text(f.dataType) for f in kind.fields)
        return isinstance(kind, StringType)

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def parse_amount(c: Column) -> Column:
    """Money in a text, or null: needs a money word or sign, or to be one grouped number.

    The first number counts. Groups of three after points or commas are thousands, else a comma is a
    decimal point. `millones` and `palo(s)` multiply by a million; `mil`, `m` and `mm` by a thousand, and
    so does `millon`, whose ending the contract's pattern does not take (kept as it is).
    """
    monetary = c.rlike(f"(?i){MONEY_WORDS}") | c.rlike(r"^\s*\$?\d{1,3}(?:[.,]\d{3})+\s*$")
    pattern = r"(?i)(\d+(?:[.,]\d+)*)\s*(millones?|mm?|palos?|mil)?"
    number, suffix = F.regexp_extract(c, pattern, 1), F.lower(F.regexp_extract(c, pattern, 2))
    plain = F.when(number.rlike(r"^\d{1,3}([.,]\d{3})+$"), F.regexp_replace(number, "[.,]", "")).otherwise(F.replace(number, F.lit(","), F.lit(".")))
    factor = F.when(suffix.startswith("millon") | suffix.startswith("palo"), 1_000_000.0).when(suffix.startswith("m"), 1_000.0).otherwise(1.0)
    return F.when(monetary, plain.try_cast("double") * factor)


def classify_error(message: Column) -> Column:
    """Class of a failed request, by the first rule whose words occur in the message."""
    low = F.lower(message)
    out = None
    for name, marks in ERROR_RULES:
        test = F.lit(False)
        for m in marks:
            test = test | low.contains(m)
        if name == "model_unavailable":
            test = test | (low.contains("model") & low.contains("available"))
        out = (F if out is None else out).when(test, name)
    return out.otherwise("structured_output_invalid")


@F.pandas_udf(StringType())
def normalize_model(s: pd.Series) -> pd.Series:
    """Model names compared by letters and digits alone, all accents folded; null gives "". For distinct values."""

    def one(v: str | None) -> str:
        if v is None:
            return ""
        low = "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)).lower()
        return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in low).split())

    return s.map(one)


@F.pandas_udf(StringType())
def normalize_evidence(s: pd.Series) -> pd.Series:
    """Evidence compared without regard to compatibility forms, case and white space."""
    return s.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split()))
