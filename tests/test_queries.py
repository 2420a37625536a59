"""Every core query against its SQL on the smallest data; those without SQL must give rows."""

import pytest

from tools.compare import compare
from weftline.plans import CORE


@pytest.mark.parametrize("name", list(CORE.queries))
def test_query(spark, con, data, name):
    said = compare(spark, con, data, name, CORE.queries[name], CORE.sql.get(name))
    assert said.startswith(("same", "rows only")), said
    assert "types" not in said, said
    assert "rows only: 0 " not in said, said


def test_entry_has_rows(spark, data):
    assert CORE.queries["q_gate_activity"](spark, data).count() > 0
