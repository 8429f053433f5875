"""Every query runs on plain, odd and empty tables, and agrees with its SQL where it has one."""

import oracle
import pytest

from quizlake.plans import reference, upkeep

QUERIES = {n: (f, m.SQL.get(n)) for m in (reference, upkeep) for n, f in m.QUERIES.items()}
#: Columns the null rows bring in which SQL's answer is not defined alike: these run only.
RUN_ONLY = {("odd", n) for n in ("specific_exam",)}
#: On empty tables these raise.
RAISING = {"specific_exam": "no questions", "flat_exam": "fewer than", "mock_exam": "has 0 of"}


@pytest.mark.parametrize("variant", ["plain", "odd", "empty"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folders, name, variant):
    f, sql = QUERIES[name]
    if name in RAISING and variant == "empty":
        with pytest.raises(ValueError, match=RAISING[name]):
            f(spark, folders[variant])
        return
    df = f(spark, folders[variant])
    if sql is None or (variant, name) in RUN_ONLY:
        df.collect()
    else:
        assert oracle.differences(df, oracle.database(folders[variant]), sql) == ([], [])
