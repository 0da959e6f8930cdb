"""Pieces of docs move once, by doc."""

import re

import pytest

from pathloom.functions import text as T
from pathloom.operators import bm25


def test_pieces_move_by_doc_alone(spark):
    pieces = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "a d"), (1, 2, "e f g"), (2, 0, "a"), (2, 1, "b"), (3, 0, "x"), (3, 1, "x")], "doc long, pos int, piece string")
    queries = spark.createDataFrame([(1, "d d e"), (2, "zz"), (3, "x")], "doc long, text string")
    best = bm25.best_piece(pieces, queries, T.whitespace_tokens)
    plan = best._jdf.queryExecution().executedPlan().toString()
    moves = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert moves and not any(re.search(r"\b(pos|len)#", m) for m in moves)
    got = {r.doc: (r.pos, r.piece, r.score) for r in best.collect()}
    assert got[1][:2] == (1, "a d") and got[1][2] > 0 and got[2] == (0, "a", 0.0)
    # of two pieces with x the idf is negative, and so a share of the mean, itself negative: the first of the equal pieces
    assert got[3][:2] == (0, "x") and got[3][2] == pytest.approx(0.25 * -1.6094379, abs=1e-6)
