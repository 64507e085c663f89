"""Literal rows for queries whose vocabulary the tables do not hold; the SQL reads the same rows as VALUES."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_FILL = "The harbour office keeps a ledger of every boat that comes in and writes the time beside its name before noon on each day."

PROMPTS = [
    (1, "You are a clerk. Always answer in full.\n\n## Rules\n1. Name the boat first.\n2. Never guess the time of arrival.\n\n## Background\nThe harbour was founded long ago. It has been open since.\n\n### Notes on the harbour\nThe pier is made of wood and stone.\n\n## Safety rules\nKeep clear of the crane at all times.\n\nQuestion: which boat came in last?"),
    (2, "\n\n".join(f"{_FILL} This is note {w}." for w in ("one", "two", "three", "four", "five"))),
    (3, "Short text."),
    (4, " \n "),
    (5, "First line here it is. Second line comes now. Third one ends it."),
    (6, "[user]\nWhat is open?\n[tool_result]\nstatus: open\nowner: pier\n[assistant]\nIt is open.\n[tool_result]\nstatus: closed"),
    (7, "\n\n".join(["tiny", f"{_FILL}", "two words", f"{_FILL} {_FILL}", f"{_FILL} And more.", "the end"])),
]
ZONES = [
    (1, "Listen to the bell at noon."), (2, "This is a hard requirement."), (3, "Give json with two keys."), (4, "From now on you are a clerk."), (5, "## Rules of the house"), (6, "<system> quiet"), (7, "Question: who came?"),
    (8, "Background of the story"), (9, "For instance a boat"), (10, "Document: the ledger"), (11, "<context> here"), (12, "It was founded in spring."), (13, "plain words without any sign"),
    (14, "Always note that it was founded early."), (15, "You must follow the rule. It has been so."), (16, "Never break a rule, act as told; it has been so."), (17, "All the rules hold."), (18, "role: clerk"), (19, "role:clerk"), (20, "table ink"),
]
STRIP = [
    (1, "It is really just a simple test of the engine."), (2, "Of course you could potentially measure the sure thing, and perhaps ensure more."), (3, "The boats were always very late, but they are mostly clean."), (4, "He said so. She went home, it was dark. They slept ."),
    (5, "No problem at all , we are happy to help ; the end  is   near !"), (6, "An old man and the sea"), (7, ""), (8, "Certainly the answer is obviously no, yet we go.\n\n\n\nNext we rest."),
]
PLAIN = [(1, "A—b –c"), (2, "‘one’ “two”…"), (3, "no break"), (4, "plain"), (5, "Café naïve"), (6, ""), (7, "Über…")]
PAIRS = [
    (1, "The answer is 1,234.5 today", "1234.5"), (2, "about 7 or 8", "7"), (3, "none", "5"), (4, " Yes ", "yes"), (5, "", ""), (6, "the cat sat on the mat", "the cat lay on the mat"), (7, "a b c d", "d c b a"), (8, "x x y", "x y y z"), (9, "", "word"), (10, "only one side", ""), (11, "-3 and +4", "4.0"),
]
MARKERS = [
    (1, '{"owner": "pier", "severity": "low"}', "format:json\nkey:owner\nkey:deadline\nrule:pier"), (2, "# Title\n1. first\n| a | b |", "format:markdown_headers\nformat:numbered_list\nformat:markdown_table\nformat:unknown\nsection:title\nnot_contains:secret"),
    (3, "no form", "format:json\nnot_contains:form"), (4, "", ""), (5, "text", ""), (6, "x", "nothing here"), (7, '{"a": {"b": 1}}', "format:json"),
]
CONTEXTS = [(1, "The total is 211 for DE-16.", "answer:211\ntool_ref:DE-16\nstale:107|211"), (2, "It was 107.", "answer:211\nstale:107|211"), (3, "No idea.", "tool_ref:DE-16\nstale:107|211\nstale:odd"), (4, "", " "), (5, "said", "other:said")]
PHRASES = [(1, "Unit 1 weighs 4 grams. unit 2 too.", "UNIT 1 weighs 4 grams\n\nUnit 3"), (2, "", ""), (3, "x", ""), (4, "abc", "a\nb\nc")]
RESULTS = [(f"s{k}", m, 0.8, round(0.8 - 0.05 * j - 0.03 * k, 4), round(-0.05 * j - 0.03 * k, 4), round(1 - 0.0625 * j - 0.0375 * k, 4), 0.3 * j, 1.5 * k) for k in range(5) for j, m in enumerate((2.0, 4.0, 16.0)) if not (m == 16.0 and k)]
SURVIVAL = [(m, c, i, f"q{i}", (i * 7 + len(m) + len(c)) % 5 / 4) for m in ("small", "large") for c in ("base", "half", "pinned") for i in range(8)]
LEAKS = [("small", "q1"), ("small", "q5"), ("large", "q0"), ("large", "q0"), ("other", "q2")]
DEPTH = [(m, f"q{i}", ("early", "middle", "late")[i % 3], c, (i * 5 + len(m) * len(c)) % 7 / 6) for m in ("small", "large", "broken") for c in ("half", "pinned") for i in range(9)]
SWEEP = [(m, c, f"q{i}", (i % 4) / 4, (i % 3) / 4, None if c == "nocontext" else 0.25 + 0.125 * (i % 3)) for m in ("small", "large") for c in ("base", "half", "nocontext") for i in range(6)]
BUDGETS = [(1, 0.2, 1000, 400), (2, 0.5, 1000, 400), (3, 0.5, 1000, 0), (4, 0.0, 50, 50), (5, 0.75, 1000, 750)]
MULTIPLIERS = [(1.0,), (1.25,), (2.0,), (4.0,), (8.0,), (16.0,)]


def disjoint(n: int) -> str:
    """``n`` sentences of three words, none of which occurs twice."""
    word = lambda k: "z" + "".join(chr(97 + k // 26**p % 26) for p in (2, 1, 0))
    return " ".join(f"{word(3 * k).capitalize()} {word(3 * k + 1)} {word(3 * k + 2)}." for k in range(n))


DISJOINT = [(n, disjoint(n)) for n in (6, 7, 9, 12, 20, 33)]


def frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def values(rows: Sequence[tuple], name: str, *columns: str) -> str:
    """The rows as a common table expression ``name(columns)``."""

    def cell(x: object) -> str:
        if x is None:
            return "NULL"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)

    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)})"
