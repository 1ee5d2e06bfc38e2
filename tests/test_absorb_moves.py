"""How often the flows are moved before handlers are absorbed."""

from factgraph.operators import absorb
from factgraph.plans import absorb as plans

SF = "/root/testdata/sf0.001"


def test_flows_are_made_unique_where_their_lines_lie(spark, capsys, monkeypatch):
    given = []
    monkeypatch.setattr(absorb, "absorb_handlers", lambda components, flows, *rest: given.append(flows))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans._absorbed(spark, SF)
        capsys.readouterr()
        given[0].explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2
    assert given[0].count() == given[0].select("id").distinct().count()
