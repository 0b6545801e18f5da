"""The boundary to a model: a callable answers a section's chunks, within tasks, with retries; offline stand-ins take its place in tests."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quire.functions.constants import RETRIES, ROW_FIELDS, TOP_FIELDS

#: (message, errors of the attempt before) to a JSON text.
Provider = Callable[[str, list[str]], str]
ANSWER = "status string, attempts int, response string, errors array<string>, prompt_tokens long, completion_tokens long, failures array<struct<attempt:int,response:string>>"


def characters(text: str) -> int:
    """The stand-in's tokens: one for every four characters begun."""
    return (len(text) + 3) // 4


def problems(body: dict) -> list[str]:
    """What makes an answer unusable and no repair can mend; the rule of verify.structure_hard()."""
    if missing := [f"Missing field: {f}" for f in TOP_FIELDS if f not in body]:
        return missing
    if not isinstance(body["annotations"], list):
        return ["annotations must be an array"]
    out = []
    for i, row in enumerate(body["annotations"]):
        if isinstance(row, dict):
            out += [f"annotations[{i}] missing field: {f}" for f in ROW_FIELDS if f not in row]
        else:
            out.append(f"annotations[{i}] must be an object")
    return out


def corrected(message: str, errors: list[str]) -> str:
    """The message with the first 20 errors of the attempt before."""
    return message + "\n\nCorrect these:\n" + "\n".join(f"- {e}" for e in errors[:20]) if errors else message


def _ask(section: dict, chunks: list[dict], provider: Provider, errors: list[str], tokens: Callable[[str], int]) -> tuple[dict, int, int]:
    """One attempt at a section: its answer as a whole, and the tokens of its messages and answers."""
    sent = got = 0
    bodies = []
    for chunk in chunks:
        # only a section of one request is told what was wrong
        told = errors if len(chunks) == 1 else []
        message = corrected(chunk["message"], told)
        answer = provider(message, told[:20])
        sent, got = sent + tokens(message), got + tokens(answer)
        body = json.loads(answer)
        if not isinstance(body, dict):
            raise ValueError("the answer is not an object")
        bodies.append(body | {"chapter_number": section["number"], "chapter_title": section["title"], "start_page": chunk["chunk_start"], "end_page": chunk["chunk_end"]})
    if len(bodies) == 1:
        return bodies[0], sent, got
    rows = sorted((row for body in bodies for row in body.get("annotations", [])), key=lambda row: row.get("page", 0))
    return bodies[0] | {"start_page": section["start_page"], "end_page": section["end_page"], "annotations": rows}, sent, got


def annotate(requests: DataFrame, provider: Provider, retries: int = RETRIES, tokens: Callable[[str], int] = characters) -> DataFrame:
    """requests (book, number, title, start_page, end_page, chunks) with ANSWER; chunks: array of (chunk_ix, chunk_start, chunk_end, message).

    Up to ``retries`` attempts for a section, each of all its chunks. An attempt fails if a call does, if an answer is
    no JSON object, or for problems(). What failed is in failures; tokens are those of all attempts that were answered.
    status: completed (response: the section as JSON, its number, title and pages put right) or failed (errors: the last
    attempt's). Write the result before reading it twice: rows are not worked out for free.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for section in batch.to_dict("records"):
                section = {k: int(v) if k in ("number", "start_page", "end_page") else v for k, v in section.items()}
                chunks = [{k: int(v) if k != "message" else v for k, v in c.items()} for c in sorted((dict(c) for c in section["chunks"]), key=lambda c: c["chunk_ix"])]
                errors, failures, sent, got = [], [], 0, 0
                for attempt in range(1, retries + 1):
                    try:
                        body, more_sent, more_got = _ask(section, chunks, provider, errors, tokens)
                    except Exception as e:  # the model's end failed: that is an attempt
                        errors, body = [f"call failed: {e}"], None
                        failures.append({"attempt": attempt, "response": str(e)})
                        continue
                    sent, got = sent + more_sent, got + more_got
                    errors = problems(body)
                    if not errors:
                        break
                    failures.append({"attempt": attempt, "response": json.dumps(body, ensure_ascii=False)})
                good = not errors
                rows.append(("completed" if good else "failed", attempt, json.dumps(body, ensure_ascii=False) if good else None, errors, sent, got, failures))
            out = batch.drop(columns="chunks").reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])], axis=1)

    schema = f"book {requests.schema['book'].dataType.simpleString()}, number long, title string, start_page long, end_page long, {ANSWER}"
    return requests.select("book", "number", "title", "start_page", "end_page", "chunks").mapInPandas(run, schema)


def first_words(message: str, errors: list[str]) -> str:
    """An offline stand-in: on every page to read, notes on its first eight words and on those from the third on."""
    notes = []
    _, _, pages = message.partition("The pages to read")
    for part in pages.partition("\n\nCorrect these:\n")[0].split("=== PAGE ")[1:]:
        number, _, rest = part.partition(" ===\n\n")
        words = rest.split()
        for k, quote in enumerate((words[:8], words[2:10])):
            note = {"page": int(number), "book_text": " ".join(quote), "annotation": "The page opens with these words", "category": ["CONTEXT", "PLOT"][int(number) % 2], "grounding": "source_fact"}
            if quote and (not k or quote != words[:8]):
                notes.append(note)
    return json.dumps({"chapter_number": 0, "chapter_title": "", "start_page": 0, "end_page": 0, "annotations": notes}, ensure_ascii=False)


def unsteady(message: str, errors: list[str]) -> str:
    """A stand-in that leaves out fields at first where a section's number and its book's, added, leave 4 by 5, and fails where they leave 6 by 7."""
    book, section = (int(re.search(pattern, message)[1]) for pattern in (r"Title: Book (\d+)", r"\nSection (\d+): "))
    if (book + section) % 7 == 6:
        return "[]"
    if (book + section) % 5 == 4 and not errors:
        return json.dumps({"annotations": [{"page": 1}, "text"]})
    return first_words(message, errors)
