"""Quality predicates as boolean columns, and their combinations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftloom.functions import text as T


class Rule(Protocol):
    """A predicate over an instruction and an output."""

    def __call__(self, instruction: Column, output: Column) -> Column: ...


@dataclass(frozen=True)
class LengthRule:
    """Inclusive bounds in characters."""

    min_instruction: int = 5
    max_instruction: int = 4000
    min_output: int = 10
    max_output: int = 8000

    def __call__(self, instruction: Column, output: Column) -> Column:
        return F.length(instruction).between(self.min_instruction, self.max_instruction) & F.length(output).between(self.min_output, self.max_output)


@dataclass(frozen=True)
class RatioRule:
    """Upper bounds, themselves allowed."""

    max_special: float = 0.3
    max_word_repetition: float = 0.5
    max_char_repetition: float = 0.5

    def __call__(self, instruction: Column, output: Column) -> Column:
        special = (T.special_char_ratio(instruction) <= self.max_special) & (T.special_char_ratio(output) <= self.max_special)
        return special & (T.char_repetition_ratio(output) <= self.max_char_repetition) & (T.word_repetition_ratio(output) <= self.max_word_repetition)


@dataclass(frozen=True)
class NgramDiversityRule:
    """Lower bound, itself allowed."""

    min_diversity: float = 0.2
    n: int = 3
    unit: str = "char"

    def __call__(self, instruction: Column, output: Column) -> Column:
        return T.ngram_diversity(output, self.n, unit=self.unit) >= self.min_diversity


@dataclass(frozen=True)
class RuleSet:
    """All rules, cheap ones first: a rule is evaluated only where those before it hold."""

    rules: tuple[Rule, ...]

    def __call__(self, instruction: Column, output: Column) -> Column:
        return reduce(lambda rest, rule: F.when(rule(instruction, output), rest).otherwise(F.lit(False)), reversed(self.rules), F.lit(True))


def quality_rules(**bounds: int) -> RuleSet:
    return RuleSet((LengthRule(**bounds),))


def cleaner_rules(length: LengthRule = LengthRule(), ratio: RatioRule = RatioRule(), diversity: NgramDiversityRule = NgramDiversityRule()) -> RuleSet:
    return RuleSet((length, ratio, diversity))


def apply_rules(df: DataFrame, rules: Rule, instruction: str = "instruction", output: str = "output") -> DataFrame:
    return df.where(rules(F.col(instruction), F.col(output)))


def emit_gate(df: DataFrame) -> DataFrame:
    """Rows with both texts, or with messages."""
    both = (F.length("instruction") > 0) & (F.length("output") > 0)
    return df.where(both | (F.size(F.coalesce("messages", F.array())) > 0)) if "messages" in df.columns else df.where(both)


def evolution_is_valid(evolved: Column, original: Column, low: float = 0.5, high: float = 5.0) -> Column:
    """Not empty, not the original, of fitting length, no refusal."""
    return (F.length(evolved) > 0) & (evolved != original) & T.length_ratio(evolved, original).between(low, high) & ~T.is_refusal(evolved)


def backtranslation_is_valid(instruction: Column, source: Column, longest: int = 500, copied: float = 0.8, from_length: int = 30) -> Column:
    """Short enough, no pointer to unseen text, not the source, not mostly copied from it; the costly test comes last."""
    cheap = (F.length(instruction) <= longest) & ~T.refers_to_context(instruction) & (T.strip(instruction) != T.strip(source))
    return F.when(~cheap, False).when(F.length(instruction) < from_length, True).otherwise(T.copied_ratio(instruction, source) < copied)


def document_qa_is_valid(instruction: Column, output: Column, longest_instruction: int = 500, longest_output: int = 4000) -> Column:
    fits = F.length(instruction).between(1, longest_instruction) & F.length(output).between(1, longest_output)
    return fits & ~T.refers_to_context(instruction)


def score_filter(df: DataFrame, min_total: float = 0.0, max_disagreement: float = 0.0) -> DataFrame:
    """Rows that score enough and whose judges agree; no filter at all where ``min_total`` is 0 or less."""
    if min_total <= 0:
        return df
    keep = F.coalesce("total_score", F.lit(0.0)) >= min_total
    if max_disagreement > 0 and "judge_disagreement" in df.columns:
        keep = keep & (F.coalesce("judge_disagreement", F.lit(0.0)) <= max_disagreement)
    return df.where(keep)
