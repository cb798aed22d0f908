import threading

import pytest

from quarryflow.sources import scratch
from quarryflow.sources.scratch import Scratch, temporary_tables


def there(spark, table):
    path = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0])
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_tables_go_with_their_own_block(spark):
    rows = spark.range(3)
    outside = Scratch(spark, "a").write(rows, "t")
    others = []
    with temporary_tables():
        inside = Scratch(spark, "b").write(rows, "t")
        with temporary_tables():
            deeper = Scratch(spark, "c").write(rows, "t")
        assert not there(spark, deeper) and there(spark, inside)
        thread = threading.Thread(target=lambda: others.append(Scratch(spark, "d").write(rows, "t")))
        thread.start()
        thread.join()
    assert not there(spark, inside) and there(spark, outside) and there(spark, others[0])


def test_tables_go_after_a_failure(spark):
    held = []
    with pytest.raises(ZeroDivisionError), temporary_tables():
        held.append(Scratch(spark, "e").write(spark.range(2), "t"))
        raise ZeroDivisionError
    assert not there(spark, held[0])
    kept = len(scratch._left)
    with temporary_tables():
        Scratch(spark, "f")
    assert len(scratch._left) == kept
