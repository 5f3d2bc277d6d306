"""Prompts as columns of role and content structs.

Roles are set here and never parsed out of rendered text, so a document with lines like ``user:`` stays one message.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sftloom.functions.text import strip

LANGS = ("en", "zh")
SYSTEM = {
    "planner": {"en": "You design coverage plans for training data. Answer with JSON.", "zh": "你负责为训练数据制定覆盖计划。请用 JSON 回答。"},
    "topic": {"en": "You write instruction and answer pairs on a topic. Answer with JSON.", "zh": "你围绕主题编写指令与回答。请用 JSON 回答。"},
    "seed": {"en": "You write new training samples in the spirit of given ones. Answer with JSON.", "zh": "你参照示例编写新的训练样本。请用 JSON 回答。"},
    "evolve": {"en": "You rewrite instructions. Answer with the new instruction alone.", "zh": "你改写指令。只输出新的指令。"},
    "answer": {"en": "You answer instructions thoroughly. Answer with JSON.", "zh": "你认真回答指令。请用 JSON 回答。"},
    "backtranslate": {"en": "You find the request that a text would be the ideal answer to. Answer with JSON.", "zh": "你推断一段文字所回答的请求。请用 JSON 回答。"},
    "document_qa": {"en": "You ask questions that a document answers and answer them from it. The question must stand on its own. Answer with JSON.", "zh": "你依据文档提问并作答，问题须能独立理解。请用 JSON 回答。"},
    "judge": {"en": "You grade training samples strictly. Answer with one JSON object of numbers.", "zh": "你严格评分。请用一个 JSON 数字对象回答。"},
}
KEYS = {
    "topic": "Keys of each item: instruction, output",
    "topic_reasoning": "Keys of each item: instruction, output, reasoning",
    "topic_multi_turn": "Key of each item: messages, a list of role and content",
    "seed": "Keys: system, instruction, output",
    "seed_multi_turn": "Key: messages, a list of role and content",
    "answer": "Keys: instruction, output",
    "answer_reasoning": "Keys: instruction, output, reasoning",
    "backtranslate": "Keys: instruction, task_type",
    "document_qa": "Keys: instruction, output, task_type",
}


TOPICS = {
    "ai": ("Artificial Intelligence", "人工智能"),
    "business": ("Business Management", "商业管理"),
    "cs": ("Computer Science", "计算机科学"),
    "education": ("Education", "教育学习"),
    "engineering": ("Engineering", "工程技术"),
    "health": ("Medicine & Health", "医学健康"),
    "humanities": ("Humanities & Arts", "人文艺术"),
    "math": ("Mathematics", "数学"),
    "science": ("Natural Science", "自然科学"),
    "social": ("Social Science", "社会科学"),
}
ROLE_LINE = re.compile(r"^(system|user|assistant):[ \t]*", re.M)


def topic_name(code: Column, lang: str = "en") -> Column:
    """A topic code's name; other values are names already."""
    names = F.create_map(*[F.lit(x) for k, v in TOPICS.items() for x in (k, v[lang == "zh"])])
    return F.coalesce(F.try_element_at(names, code), code)


def split_list(value: Column, sep: str = ",") -> Column:
    """Parts between separators, stripped; blank ones go."""
    return F.filter(F.transform(F.split(value, re.escape(sep)), strip), lambda x: F.length(x) > 0)


def knowledge_lines(knowledge: Column, count: Column) -> Column:
    """Sub-topics of a topic's knowledge: one for each item where there are enough, else all of them, to be covered; null without any."""
    parts = split_list(F.translate(knowledge, "，", ","))
    numbered = F.transform(F.slice(parts, 1, F.greatest(count, F.lit(1)).cast("int")), lambda x, i: F.concat(F.lit("Item "), (i + 1).cast("string"), F.lit(" is about: "), x))
    return F.when(F.size(parts) == 0, None).when(count <= F.size(parts), F.array_join(numbered, "\n")).otherwise(F.concat(F.lit("Cover all of: "), F.array_join(parts, ", ")))


def parse_chat(text: str) -> list[dict[str, str]]:
    """Messages of a text whose lines may begin with a role and a colon; what comes before the first of them is left out.

    For templates that a person wrote; never for texts of a dataset.
    """
    marks = list(ROLE_LINE.finditer(text))
    ends = [m.start() for m in marks[1:]] + [len(text)]
    return [{"role": m[1], "content": text[m.end() : end].strip()} for m, end in zip(marks, ends)]


def lookup(kind: str, lang: str = "en") -> str:
    """System message of a kind in the language, else in English."""
    if kind not in SYSTEM:
        raise ValueError(f"unknown prompt {kind}; known: {sorted(SYSTEM)}")
    return SYSTEM[kind].get(lang, SYSTEM[kind]["en"])


class Builder:
    """A list of messages, made step by step."""

    def __init__(self, lang: str = "en"):
        self.lang, self.messages = lang, []

    def add(self, role: str, content: str) -> Builder:
        self.messages.append({"role": role, "content": content})
        return self

    def template(self, kind: str, user: str = "", **values: object) -> Builder:
        """The kind's system message, and a user message whose {names} are filled in."""
        self.add("system", lookup(kind, self.lang))
        return self.add("user", user.format(**values)) if user else self

    def examples(self, pairs: list[tuple[str, str]]) -> Builder:
        for instruction, output in pairs:
            self.add("user", instruction).add("assistant", output)
        return self

    def build(self) -> list[dict[str, str]]:
        return list(self.messages)


def message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), (F.lit(content) if isinstance(content, str) else content).alias("content"))


def prompt(kind: str, *lines: Column | str, lang: str = "en") -> Column:
    """System and user message; null lines are left out."""
    system = lookup(kind, lang)
    user = F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])
    return F.array(message("system", system), message("user", user))


def labelled(label: str, value: Column) -> Column:
    return F.when(F.length(value.cast("string")) > 0, F.concat(F.lit(f"{label}: "), value.cast("string")))


def templates() -> list[str]:
    """Names and languages of all prompts."""
    return sorted(f"{k}_{lang}" if lang != "en" else k for k, v in SYSTEM.items() for lang in v)
