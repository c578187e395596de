"""A dump of a whole database as text."""

import datetime
import decimal
import glob

from archloom.operators.dump import dump, write_dump


def test_dump_in_order_with_all_types(spark, tmp_path):
    row = (1, "it's \\ a\nline", None, bytearray(b"\x00\xff"), True, decimal.Decimal("1.50"), datetime.date(2024, 2, 29), datetime.datetime(2024, 2, 29, 1, 2, 3, 4), 2.5, [1, 2])
    odd = spark.createDataFrame([row], "id long, text string, none string, raw binary, flag boolean, price decimal(9,2), day date, at timestamp, x double, list array<int>")
    many = spark.range(10).selectExpr("id % 5 as k", "id as `odd``name`")
    d = dump(spark, "db", {"odd": (odd, ["id"]), "many": (many, ["k"]), "empty": (many.where("false"), ["k"])}, {"w": "CREATE VIEW w AS SELECT 2", "v": "CREATE DEFINER=a@b VIEW v AS SELECT 1"}, chunk=4)
    rows = d.orderBy("place", "chunk").collect()
    assert [(r.place, r.name, r.chunk) for r in rows] == [(0, "", -1), (1, "empty", -1), (2, "many", -1), (2, "many", 0), (2, "many", 1), (2, "many", 2), (3, "odd", -1), (3, "odd", 0), (4, "v", -1), (5, "w", -1), (6, "", -1)]
    text = {(r.name, r.chunk): r.sql for r in rows}
    assert text["odd", 0] == "INSERT INTO `odd` VALUES\n(1, 'it\\'s \\\\ a\\nline', NULL, 0x00ff, 1, 1.50, '2024-02-29', '2024-02-29 01:02:03.000004', 2.5, '[1,2]');"
    assert text["many", 0] == "INSERT INTO `many` VALUES\n(0, 0),\n(0, 5),\n(1, 1),\n(1, 6);" and text["many", 2] == "INSERT INTO `many` VALUES\n(4, 4),\n(4, 9);"
    assert "`odd``name` bigint NOT NULL" in text["many", -1] and "`price` decimal(9,2)" in text["odd", -1]
    assert text["v", -1] == "DROP VIEW IF EXISTS `v`;\nCREATE VIEW v AS SELECT 1;"
    write_dump(d, str(tmp_path / "dump"))
    whole = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/dump/part-*")))
    assert whole == "".join(r.sql + "\n\n" for r in rows)
