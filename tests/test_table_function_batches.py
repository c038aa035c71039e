"""Table functions take few rows at a time, however many a partition holds."""

from pyspark.util import PythonEvalType

from scriptoria.functions import tables as U


def test_table_functions_do_not_hold_large_batches():
    assert {f.evalType for f in U.FUNCTIONS.values()} == {PythonEvalType.SQL_TABLE_UDF}
