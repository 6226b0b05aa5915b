"""Property tests (hypothesis): include and exclude split the rows exactly,
with the comparison rules of W01."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fleetlens import operators as op

NAMES = st.sampled_from(["hdfs", "HDFS", "Yarn", "hive", " hive", "pig", ""])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.lists(st.one_of(st.none(), NAMES), max_size=12),
       listed=st.lists(NAMES.filter(lambda s: s != "" and "," not in s), min_size=1, max_size=3))
def test_include_exclude_partition(spark, keys, listed):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k string")
    text = ",".join(listed)
    inc = {r.id for r in op.keep_listed(df, "k", include=text).collect()}
    exc = {r.id for r in op.keep_listed(df, "k", exclude=text).collect()}
    wanted = {n.upper() for n in text.split(",")}
    model_inc = {i for i, k in enumerate(keys) if k is not None and k.upper() in wanted}
    assert inc == model_inc
    assert exc == set(range(len(keys))) - model_inc
