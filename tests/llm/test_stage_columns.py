"""Stages keep columns whose names the operators use themselves; the vocabulary travels with its class."""

from __future__ import annotations

import pickle
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from cohortloom.llm import pieces
from cohortloom.llm.decontamination import decontamination_stage
from cohortloom.llm.language import language_stage
from cohortloom.llm.lines import line_stage
from cohortloom.llm.near_duplicates import near_duplicate_stage

OWN = ["_id", "_print", "_removed", "_text", "lang_pred", "lang_score", "lang_rejected", "_lost_id", "_lost_print", "_row", "component_id", "removed", "print"]
LINE = "the weather in the north was cold and the people of the town stayed at home that day"


@pytest.mark.parametrize("stage", [language_stage, line_stage, near_duplicate_stage, decontamination_stage])
def test_clashing_columns_come_back_as_they_were(spark, folder, stage):
    rows = [(k, f"{LINE} {k * 7}\n{LINE}\n{LINE} once more {k}", "en", *[f"{c}{k}" for c in OWN]) for k in range(4)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", *[f"`{c}` string" for c in OWN]]))
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns
    got = {r["doc_id"]: [r[c] for c in OWN] for r in out.collect()}
    assert got and all(own == [f"{c}{k}" for c in OWN] for k, own in got.items())


def test_vocabulary_needs_no_package(tmp_path):
    """Unpickled by a process that can't import the package."""
    path = tmp_path / "vocabulary"
    path.write_bytes(cloudpickle.dumps(pieces.load()))
    code = "import pickle, sys; v = pickle.load(open(sys.argv[1], 'rb')); print(type(v).__name__, 'cohortloom' in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code, str(path)], capture_output=True, text=True, cwd=tmp_path, env={"PATH": "/usr/bin"})
    assert done.stdout.split() == ["Vocabulary", "False"], done.stderr[-500:]
    assert pickle.loads(path.read_bytes())
