from conftest import SF

from tracewell.__main__ import main


def test_commands(spark, capsys):
    assert main(["list"]) == 0 and "usage_cost" in capsys.readouterr().out
    assert main(["sql", "usage_daily"]) == 0 and "GROUP BY" in capsys.readouterr().out
    assert main(["run", "usage_primary_model", "--data", SF]) == 0 and "primary_model" in capsys.readouterr().out
