"""Accent-free text normalisation and the attribution guard, as expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- Fixed values: attribution patterns and negations ----------------------
FALSE_ATTRIBUTION = (
    r"\b(?:projeto|produto|plataforma|observatorio|iniciativa|servico)"
    r"(?:\s+experimental)?\s+(?:do|da|de)\s+(?:o\s+)?ipma\b",
    r"\b(?:criado|desenvolvido|mantido|operado|produzido|financiado)"
    r"\s+(?:pela|pelo)\s+(?:equipa\s+do\s+)?ipma\b",
    r"\bequipa\s+do\s+ipma\s+(?:criou|desenvolveu|mantem|opera)\b",
)
NEGATIONS = ("nao ", "nunca ", "not ")
LOOK_BACK = 55
SUBJECT_TOKENS = (
    "projeto", "project", "observatorio", "plataforma", "aplicacao",
)
QUESTION_PHRASES = (
    "quem criou", "quem desenvolveu", "quem fez", "qual e o autor", "qual a autoria",
    "quem e o criador", "criado por quem", "desenvolvido por quem", "e do ipma",
    "projeto do ipma", "equipa do ipma", "relacao com o ipma",
    "qual e a relacao", "ligacao ao ipma",
    "afiliado ao ipma", "who created", "who developed", "created by",
    "is this an ipma project", "affiliated with ipma",
)


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition (NFKD) without combining marks."""
    return texts.map(
        lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    )


def normalise_text(column: Column) -> Column:
    """Lower case, accents stripped, compatible letters folded, whitespace collapsed.

    Only text beyond ASCII goes through Python, in Arrow batches.
    """
    text = F.coalesce(column, F.lit(""))
    other = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    folded = F.coalesce(_compatible(other), text)
    return F.regexp_replace(F.regexp_replace(F.lower(folded), r"(?U)\s+", " "), "^ | $", "")


def _contains_any(column: Column, tokens: tuple[str, ...]) -> Column:
    result = F.lit(False)
    for token in tokens:
        result = result | column.contains(token)
    return result


def is_identity_question(column: Column, project_names: tuple[str, ...] = ()) -> Column:
    """Asks who made the project or whether it belongs to an institution.
    ``project_names``: the deployment's own name, accent-free lower case."""
    text = normalise_text(column)
    subjects = (*SUBJECT_TOKENS, *project_names)
    phrases = (*QUESTION_PHRASES, *[f"relacao do {name} com o ipma" for name in project_names])
    return _contains_any(text, subjects) & _contains_any(text, phrases)


def has_false_attribution(column: Column) -> Column:
    """True when some sentence affirms the attribution without a negation in
    the 55 characters before the first match of a pattern."""
    sentences = F.split(normalise_text(column), r"(?<=[.!?;])\s+")

    def affirmed(sentence: Column) -> Column:
        result = F.lit(False)
        for pattern in FALSE_ATTRIBUTION:
            # What stands before the first match, found by the match itself.
            before = F.regexp_extract(sentence, f"^(.*?)(?:{pattern})", 1)
            near = F.right(before, F.lit(LOOK_BACK))
            result = result | (sentence.rlike(pattern) & ~_contains_any(near, NEGATIONS))
        return result

    return F.exists(sentences, affirmed)


def enforce_guard(column: Column, replacement: str) -> Column:
    return F.when(has_false_attribution(column), F.lit(replacement)).otherwise(column)
