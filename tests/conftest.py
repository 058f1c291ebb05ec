"""Session and small survey tables used by all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from visitgauge.schema import ITEMS  # noqa: E402
from visitgauge.session import local_session  # noqa: E402

# Totals on either side of every boundary between levels.
TOTALS = [0, 4, 5, 9, 10, 14, 15, 19, 20, 27]
PEOPLE_PER_TOTAL = 6
COMPLETE = len(TOTALS) * PEOPLE_PER_TOTAL
#: First answers that don't count: refused, unknown and absent.
NO_ANSWERS = ["7", "9", ""]


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "visitgauge-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


def answers_of(total: int, shift: int) -> list[int]:
    """Nine answers with a total, dealt out one by one from the item ``shift`` on."""
    answers = [0] * 9
    for k in range(total):
        answers[(k + shift) % 9] += 1
    return answers


def survey_rows() -> tuple[list[str], list[str]]:
    """Complete people, people with an invalid answer, and one person in each file alone."""
    sheets = [
        (501 + 3 * k, answers_of(TOTALS[k % len(TOTALS)], k)) for k in range(COMPLETE)
    ] + [(9001 + k, [text, *answers_of(8, k)[1:]]) for k, text in enumerate(NO_ANSWERS)]
    demographic = ["SEQN,RIDAGEYR,RIAGENDR,RIDRETH1,INDHHIN2,DMDEDUC2,DMDMARTL"]
    for place, key in enumerate([key for key, _ in sheets] + [9100]):
        income = [3, 77, 8, 99, 14, ""][place % 6]
        codes = [12 + place * 7 % 80, place % 2 + 1, place % 5 + 1, income, [1, 4, 7][place % 3], place % 6 + 1]
        demographic.append(",".join(map(str, [key, *codes])))
    answers = ["SEQN," + ",".join(ITEMS)]
    answers += [",".join(map(str, [key, *given])) for key, given in [*sheets, (9200, answers_of(3, 0))]]
    return demographic, answers


@pytest.fixture(scope="session")
def survey_files(tmp_path_factory) -> dict[str, str]:
    folder = tmp_path_factory.mktemp("raw")
    paths = {}
    for name, lines in zip(("demographic", "questionnaire"), survey_rows()):
        path = folder / f"{name}.csv"
        path.write_text("\n".join(lines) + "\n")
        paths[name] = str(path)
    return paths
