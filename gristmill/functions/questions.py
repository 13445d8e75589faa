"""From generated text to questions and answers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.text import lines, strip


def question_lines(text: Column, mark: str = "?") -> Column:
    """Stripped lines that end with the mark; null when there are none."""
    kept = F.filter(F.transform(lines(text), strip), lambda x: F.endswith(x, F.lit(mark)))
    return F.when(F.size(kept) > 0, kept)


_LABELLED = re.compile(r"[Qq]\d+:\s*(.+?\?)$")
_NUMBERED = re.compile(r"\d+\.\s*(.+?\?)")
#: Fixed values, in the order in which they are taken out.
_LABELS = ("Q:", "Question:", "1.", "2.", "3.", "4.", "5.", "6.", "7.", "8.", "9.", "10.")


def _of_line(line: str) -> list[str]:
    found = []
    labelled = line[:1] in ("Q", "q") and ":" in line
    if labelled and (m := _LABELLED.match(line)):
        found.append(m[1])
    elif labelled:
        rest = line.partition(":")[2].strip()
        if "?" in line and "?" not in rest:
            found.append(rest + "?" if len(rest) > 3 else "")
    else:
        *asked, _ = line.split("?")
        for part in asked:
            q = (part + "?").strip()
            for label in _LABELS:
                q = q.replace(label, "")
            found.append(q)
    found += _NUMBERED.findall(line)
    return [q for q in map(str.strip, found) if len(q) > 3]


def parse_questions(text: str | None) -> list[str]:
    """Questions in free generated text, first occurrences in order (labels, numbers, several a line; see the tests)."""
    whole = (text or "").strip()
    if not whole:
        return []
    found = [q for line in whole.split("\n") if (s := line.strip()) for q in _of_line(s)]
    return list(dict.fromkeys(found)) or ([] if "?" in whole else [whole + "?"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_questions_udf(text: pd.Series) -> pd.Series:
    return text.map(parse_questions)


def parsed_or_whole(text: Column) -> Column:
    """Parsed questions; without any, the stripped text as one; null for blank text."""
    parsed = parse_questions_udf(text)
    whole = strip(text)
    return F.when(F.size(parsed) > 0, parsed).when(whole != "", F.array(whole))


def clean_answer(answer: Column, question: Column) -> Column:
    """Without "Answer:" and copies of the question, stripped; null if nothing is left."""
    return F.nullif(strip(F.replace(F.replace(answer, F.lit("Answer:"), F.lit("")), question, F.lit(""))), F.lit(""))
