import json

from pyspark.sql import functions as F

from quire.operators import estimate, prompts, provider, run
from quire.operators.estimate import Settings


def tables(spark):
    pages = spark.createDataFrame([("a", p, f"page {p} has these words in it and some more") for p in range(1, 6)] + [("a", 6, None), ("b", 1, "only page")], "book string, page long, text string")
    books = spark.createDataFrame([("a", "Book 1", None, "a.pdf"), ("b", " ", "Somebody", None)], "book string, title string, author string, source_filename string")
    sections = spark.createDataFrame([("a", 1, "One", 1, 2), ("a", 2, "Two", 3, 4), ("a", 3, "Three", 5, 6), ("b", 1, "All", 1, 1)], "book string, number long, title string, start_page long, end_page long")
    return pages, books, sections


def test_run(spark):
    pages, books, sections = tables(spark)
    selected = sections.select("book", "number").unionByName(spark.createDataFrame([("a", 9), ("a", 1)], "book string, number long"))

    def model(message, errors):
        if "Section 2: Two" in message:
            return "[]"
        return provider.first_words(message, errors)

    out = run.run_pipeline(pages, books, sections, selected, model, Settings(2, "high"))
    state = {(r["book"], r["number"]): (r["state"], r["attempts"]) for r in out.answers.collect()}
    # the failure of section 2 ends its book's run; the other book is not touched by it
    assert state == {("a", 1): ("completed", 1), ("a", 2): ("failed", 3), ("a", 3): ("not_reached", 1), ("b", 1): ("completed", 1)}
    notes = sorted((r["book"], r["chapter_number"], r["seq"], r["page"], r["book_text"]) for r in out.notes.collect())
    assert notes == [("a", 1, 1, 1, "page 1 has these words in it and"), ("a", 1, 2, 1, "has these words in it and some more"), ("a", 1, 3, 2, "page 2 has these words in it and"), ("a", 1, 4, 2, "has these words in it and some more"), ("b", 1, 1, 1, "only page")]
    summary = {r["book"]: r for r in out.summary.collect()}
    a = summary["a"]
    assert (a["chapters_requested"], a["chapters_completed"], a["chapter_failed"], a["quality"], a["quotes_per_page"], a["trimmed"]) == ([1, 2, 3], [1], 2, "high", 2, 0)
    assert a["total_tokens"] == a["prompt_tokens"] + a["completion_tokens"] > 0 and a["cost"] > 0 and a["flagged_rows"] == 2
    assert out.post_errors.count() == 0
    assert sorted((r["chapter_number"], r["attempt"]) for r in out.failed_responses().collect()) == [(2, 1), (2, 2), (2, 3)]
    masters = {r["book"]: json.loads(r["json"]) for r in out.masters().collect()}
    assert [c["chapter_number"] for c in masters["a"]["chapters"]] == [1] and masters["a"]["run"]["chapter_failed"] == 2 and masters["a"]["book"] == "Book 1"
    assert [n["page"] for n in masters["a"]["chapters"][0]["annotations"]] == [1, 1, 2, 2] and masters["a"]["chapters"][0]["source_filename"] == "a.pdf"


def test_runs_of_nothing(spark):
    pages, books, sections = tables(spark)
    out = run.run_pipeline(pages, books, sections, sections.select("book", "number").limit(0), provider.first_words)
    assert out.answers.count() == out.notes.count() == out.summary.count() == out.masters().count() == 0
    # sections without notes are completed
    out = run.run_pipeline(pages, books, sections, sections.select("book", "number"), lambda m, e: json.dumps({"annotations": []}))
    assert {r["state"] for r in out.answers.collect()} == {"completed"} and out.notes.count() == 0 and {len(json.loads(r["json"])["chapters"]) for r in out.masters().collect()} == {1, 3}


def test_messages(spark):
    pages, books, sections = tables(spark)
    one = run.requests(pages.filter("text is not null"), books, sections, sections.filter("number = 2"), Settings(3)).first()
    message = one["chunks"][0]["message"]
    assert "Title: Book 1" in message and "Author: unavailable" in message and "- 2. Two (pages 3 to 4)" in message and "notes in all: at most 6" in message
    assert message.index("Opening text:") < message.index("The pages to read") < message.rindex("=== PAGE 3 ===")
    # chunks of one page: the page before is context
    long = pages.filter("text is not null").withColumn("text", F.repeat("text", 40000))
    chunks = run.requests(long, books, sections, sections.filter("number = 2"), Settings(1), tokens=lambda c: F.length(c)).first()["chunks"]
    assert [(c["chunk_start"], c["chunk_end"]) for c in chunks] == [(3, 3), (4, 4)] and "The page before" not in chunks[0]["message"] and "=== PAGE 3 ===" in chunks[1]["message"]
    frame = {r["book"]: r["frame"] for r in estimate.document_frame(books, sections.filter("book = 'a'"), long).collect()}
    assert frame["b"].endswith("Sections:\n- unavailable\n\nOpening text:\nunavailable") and frame["a"].endswith("unavailable")


def test_prompts(tmp_path):
    file = tmp_path / "prompt.txt"
    file.write_text("Base")
    assert prompts.load_system_prompt(str(file)) == "Base"
    text = prompts.load_system_prompt(str(file), Settings(7, "low"))
    assert text.startswith("Base\n\n## Density") and "7 notes at most" in text and "close reading" in text and "15 to 40" in text
    for n, words in ((1, "main claims"), (4, "main points")):
        assert words in prompts.settings_overlay(Settings(n))
    try:
        prompts.load_system_prompt(str(tmp_path / "none"))
        raise AssertionError
    except FileNotFoundError:
        pass
    body = prompts.chat_request("m", "s", "u", 5)
    schema = body["response_format"]["json_schema"]["schema"]
    assert schema["required"] == ["chapter_number", "chapter_title", "start_page", "end_page", "annotations"] and not schema["additionalProperties"]
    assert prompts.chat_provider(lambda b: b["messages"][1]["content"], "m", "s", 5)("hello", []) == "hello"


def test_tokens(spark):
    from quire.functions import tokens

    df = spark.createDataFrame([("a", "one two three"), ("b", None), ("c", "")], "k string, t string")
    count = tokens.counter(lambda: str.split)
    assert {r["k"]: r["n"] for r in df.select("k", count("t").alias("n")).collect()} == {"a": 3, "b": 0, "c": 0}
    pages = spark.createDataFrame([("a", 1, "one two three")], "book string, page long, text string")
    sections = spark.createDataFrame([("a", 1, "All", 1, 1)], "book string, number long, title string, start_page long, end_page long")
    assert estimate.section_index(pages, sections, tokens=count).first()["tokens"] == 3
