"""Decoding of model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.fixed import ANSWER_KEYS
from feedloom.functions.once import let, with_once_where


def parse_object(text: Column) -> Column:
    """One JSON object as ``map<string,string>``; NULL for anything else.

    Plain ``from_json`` ignores what follows the first value. Parsing the text
    as the inside of an array exposes that: exactly one element must come out.
    A bracket in the text could close that array early, hence a second element that
    must be the last one of the first array. It is a digest of the text, which no text
    contains.
    """

    def parsed(t: Column) -> Column:
        inside = F.from_json(
            F.concat(F.lit("["), t, F.lit("]")),
            "array<map<string,string>>",
            {"allowSingleQuotes": "false"},
        )
        mark = F.md5(t)
        closed = F.from_json(
            F.concat(F.lit("["), t, F.lit(',"'), mark, F.lit('"]')),
            "array<string>",
            {"allowSingleQuotes": "false"},
        )
        only = let(inside, lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))))
        return F.when((F.size(closed) == 2) & (F.get(closed, F.lit(1)) == mark), only)

    return let(text, parsed)


def parse_response(envelope: Column) -> Column:
    """The object held as text in the envelope's ``response`` string.

    An empty map means the model answered ``{}``; NULL means there is no usable
    answer. An absent key and an explicit null stay distinguishable.
    """
    inner = F.try_element_at(parse_object(envelope), F.lit("response"))
    return F.when(envelope.rlike(r'"response"\s*:\s*"'), parse_object(inner))


def has_answer(answer: Column) -> Column:
    """True unless the answer is NULL or empty; never NULL."""
    return F.coalesce(F.cardinality(answer) > 0, F.lit(False))


def with_answers(df: DataFrame, envelope: str, out: str = "answer") -> DataFrame:
    """Decode a column of envelopes and keep the rows that have an answer."""
    return with_once_where(df, out, parse_response(F.col(envelope)), has_answer)


def field_or(answer: Column, key: str, default: Column) -> Column:
    """``default`` only if the key is absent; an explicit null stays NULL."""
    return F.when(F.map_contains_key(answer, key), F.try_element_at(answer, F.lit(key))).otherwise(
        default
    )


_EMOJI = (
    r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{2B55}\x{231A}\x{231B}]"
)


def contract_violations(text: Column) -> Column:
    """Sorted codes of what an answer text does against the request's rules.

    ``not_json``, ``missing:<key>``, ``extra:<key>``, ``emoji`` and ``fence``;
    an empty array means the answer keeps to them.
    """
    wanted = F.array(*[F.lit(key) for key in ANSWER_KEYS])
    none = F.array().cast("array<string>")

    def coded(code: str, names: Column) -> Column:
        return F.coalesce(F.transform(names, lambda k: F.concat(F.lit(code), k)), none)

    def flag(code: str, condition: Column) -> Column:
        return F.when(condition, F.array(F.lit(code))).otherwise(none)

    def violations(answer: Column) -> Column:
        keys = F.map_keys(answer)
        return F.concat(
            flag("not_json", answer.isNull()),
            coded("missing:", F.array_except(wanted, keys)),
            coded("extra:", F.array_except(keys, wanted)),
            flag("emoji", text.rlike(_EMOJI)),
            flag("fence", F.contains(text, F.lit("```"))),
        )

    return F.array_sort(let(parse_object(text), violations))
