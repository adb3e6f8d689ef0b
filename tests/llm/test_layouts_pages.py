"""Rows without a layout, roles as given, and article text that only looks like page furniture."""

import glob
import hashlib
import os

import duckdb
import pytest

from fieldmart.llm import chat, html
from fieldmart.llm import queries as llm

LONG = "This is a long sentence of the article, with commas, words and a good deal of plain text in it, so it scores well."


def test_rows_without_a_layout_are_returned(spark):
    schema = "conv_id long, prompt string, completion string, system string, messages array<struct<role:string,content:string>>, prompt_id long"
    rows = [(1, "q", "a", None, None, 1), (2, "q", "a", "s", None, 1), (3, None, None, None, None, 1), (4, None, None, None, [("user", "x")], 1), (4, "q", None, None, None, 1), (5, None, None, None, [], 1)]
    frame = spark.createDataFrame(rows, schema)
    got = sorted((r["conv_id"], r["fields"]) for r in chat.rejects(frame).collect())
    assert got == [(2, ["completion", "prompt", "system"]), (3, []), (4, ["prompt"])]
    turned = {r["conv_id"] for r in chat.canonical_turns(frame).collect()}
    assert turned == {1, 4}
    assert chat.rejects(frame.limit(0)).count() == 0
    assert chat.rejects(frame.select("conv_id", "prompt_id")).count() == 6


def test_turn_rows_keep_their_roles(spark):
    long, hard = "x" * 300_000, "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "human", "a", 7), (1, 1, "gpt", hard, 7), (1, 1, "gpt", hard, 7), (2, 0, None, None, 7), (3, 0, "assistant", long, 7)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss_chars long")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(chat.canonical_turns(frame))).collect()}
    want = hashlib.sha256(f"human\na\ngpt\n{hard}\ngpt\n{hard}\n".encode()).hexdigest()
    assert got[1]["turns_sha256"] == want and got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 0
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    assert got[3]["loss_chars"] == 300_000 and chat.rejects(frame).count() == 0


@pytest.mark.parametrize("name", ["op3_chat", "op6_decontaminate"])
def test_query_equals_its_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    cursor = connection.execute(llm.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in llm.queries()[name](spark, sf_dir).collect()) == want


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f'<div class="post-header"><h1>Title</h1></div><p>{LONG}</p>', ["Title", LONG]),
        (f'<p class="legal">Section 5 of the act.</p><p>{LONG}</p>', ["Section 5 of the act.", LONG]),
        (f'<section id="side-effects"><p>{LONG}</p></section>', [LONG]),
        (f'<p>Take <span class="alert">great</span> care. {LONG}</p>', [f"Take great care. {LONG}"]),
        (f'<p>{LONG}</p><div class="share">Share this</div><p class="advert">Buy now</p><section class="comments"><p>{LONG} Me too.</p></section>', [LONG]),
    ],
)
def test_names_inside_an_article(body, want):
    page = f"<body><nav>menu</nav><article>{body}</article><div class='legal'><p>{LONG}</p></div></body>"
    assert html.main_blocks(page) == want


def test_articles_beside_each_other_are_kept():
    card = "<article><a href='/x'>Another story</a></article>"
    page = f"<body><div>{''.join(f'<article><h2>Part {i}</h2><p>{LONG} {i}</p></article>' for i in range(3))}{card}</div></body>"
    assert html.main_blocks(page) == [line for i in range(3) for line in (f"Part {i}", f"{LONG} {i}")]


def test_empty_and_long_pages(spark):
    schema = "page_id long, url string, html string, text string"
    assert html.extract(spark.createDataFrame([], schema)).count() == 0
    many = "".join(f"<p>{LONG} {i}</p>" for i in range(5_000))
    rows = [(1, "u", f"<article>{many}</article>", "clash"), (2, None, None, None), (None, "u", "", "x"), (1, "u", f"<article>{many}</article>", "clash")]
    got = html.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["n_chars"], r["text"].count("\n")) for r in got) == [(0, 0), (0, 0)] + 2 * [(sum(len(f"{LONG} {i}") for i in range(5_000)) + 4_999, 4_999)]
