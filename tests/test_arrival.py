import os

import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.operators import arrival
from millrace.plans.arrival import accepted_paths, arrival_job, check_landing, read_manifest, sending_plan
from millrace.sources import landing, raw
from millrace.streaming.arrival import watch_landing

POS = ",".join(schemas.POS_HEADER)
CUSTOMERS = "|".join(schemas.CUSTOMER_HEADER)
LIMIT = landing.HEAD_BYTES

FILES = {
    "pos/dt=2026-09-17/good.csv": (POS + "\n1,2\n", None),
    "pos/dt=2026-09-17/crlf.csv": (POS + "\r\n1,2\r\n", None),
    "pos/dt=2026-09-17/spaced.csv": (POS.replace(",", " , ") + "\n1\n", None),
    "pos/dt=2026-09-17/bom.csv": ("﻿" + POS + "\n1\n", None),
    "pos/dt=2026-09-18/with space+plus.csv": (POS + "\n1\n", None),
    "pos/dt=2026-09-18/empty.csv": ("", "file is empty"),
    "pos/dt=2026-09-18/bomonly.csv": ("﻿", "no header row"),
    "pos/dt=2026-09-18/blank.csv": ("  \n" + POS + "\n1\n", "no header row"),
    "pos/dt=2026-09-18/headeronly.csv": (POS + "\n \n\n", "header only, no data rows"),
    "pos/dt=2026-09-18/noeol.csv": (POS, "header only, no data rows"),
    "pos/dt=2026-09-18/order.csv": ("store_id," + POS + "\n1\n", ("unexpected header: store_id," + POS)[:99]),
    "pos/dt=2026-09-18/accent.csv": ("café\n1\n", "unexpected header: caf?"),
    "pos/dt=2026-09-18/latin.csv": (POS.encode() + b"\ncaf\xe9,1\n", "not valid UTF-8 text"),
    # The 64 KiB limit falls inside the two bytes of the last character.
    "pos/dt=2026-09-18/cut.csv": (
        POS.encode() + b"\n" + b"x" * (LIMIT - len(POS) - 2) + "é".encode() + b"\n", None),
    "pos/dt=2026-09-18/bomcut.csv": (
        b"\xef\xbb\xbf" + POS.encode() + b"\n" + b"x" * (LIMIT - len(POS) - 5) + "é".encode() + b"\n", None),
    "pos/dt=2026-09-18/cutbad.csv": (
        POS.encode() + b"\n" + b"x" * (LIMIT - len(POS) - 2) + b"\xff\n", "not valid UTF-8 text"),
    "pos/dt=2026-09-18/late.csv": (POS.encode() + b"\n" + b"x" * LIMIT + b"\xff\n", None),
    "pos/dt=2026-09-18/notes.txt": ("hello", "ignored"),
    "quarantine/pos/dt=2026-09-18/old.csv": ("x", "ignored"),
    "ecommerce/dt=2026-09-17/good.json": ('\n  \n{"orderId": null, "items": null}\nbad\n', None),
    "ecommerce/dt=2026-09-17/text.json": ("not json\n", "first line is not JSON"),
    "ecommerce/dt=2026-09-17/more.json": ('{"orderId":1,"items":[]} x\n', "first line is not JSON"),
    "ecommerce/dt=2026-09-17/list.json": ("[1,2]\n", "first line has no orderId or items"),
    "ecommerce/dt=2026-09-17/noitems.json": ('{"orderId":"x","order":{"items":[]}}\n', "first line has no orderId or items"),
    "ecommerce/dt=2026-09-17/blank.json": ("\n \n", "no data rows"),
    "ecommerce/dt=2026-09-17/long.json": ('{"orderId":1,"items":["' + "x" * LIMIT + '"]}\n', "first line is not JSON"),
    "ecommerce/dt=2026-09-18/single.json": ("{'orderId':'x','items':[]}\n", "first line is not JSON"),
    "ecommerce/dt=2026-09-18/rawtab.json": ('{"orderId":"a\tb","items":[]}\n', "first line is not JSON"),
    "ecommerce/dt=2026-09-18/tabs.json": ('{\t"orderId":\t"it\'s","items":[]}\n', None),
    "ecommerce/dt=2026-09-18/nan.json": ('{"orderId":"NaN","items":[NaN, -Infinity],"x":"\\"NaN"}\n', None),
    "ecommerce/dt=2026-09-18/notnan.json": ('{"orderId":xNaN,"items":[]}\n', "first line is not JSON"),
    "ecommerce/dt=2026-09-18/_hidden.json": ("x", "ignored"),
    "customers/dt=2026-09-28/good.txt": (CUSTOMERS + "\n1|2\n", None),
    "customers/dt=2026-09-28/comma.txt": (CUSTOMERS.replace("|", ",") + "\n1\n", "unexpected header: " + CUSTOMERS.replace("|", ",")[:80]),
}


def put(base, files):
    for key, content in files.items():
        path = os.path.join(base, key)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as stream:
            stream.write(content if isinstance(content, bytes) else content.encode())


@pytest.fixture(scope="module")
def zone(tmp_path_factory):
    base = str(tmp_path_factory.mktemp("landing") / "my zone")
    put(base, {key: content for key, (content, _) in FILES.items()})
    return base


def test_every_file_gets_its_verdict(spark, zone):
    rows = check_landing(spark, zone).collect()
    assert {row.key: row.reason for row in rows} == {k: reason for k, (_, reason) in FILES.items() if reason != "ignored"}
    for row in rows:
        assert row.status == ("accepted" if row.reason is None else "quarantined")
        assert row.target_key == (row.key if row.reason is None else f"quarantine/{row.key}")
        assert row.size == os.path.getsize(os.path.join(zone, row.key))
        assert row.source == row.key.split("/")[0] and f"/dt={row.dt}/" in row.key


def test_header_is_a_parameter(spark, tmp_path):
    put(str(tmp_path), {"pos/dt=1/a.csv": "a,b\n1,2\n"})
    assert check_landing(spark, str(tmp_path), pos_header=("a", "b")).first().status == "accepted"


def test_unreadable_file_is_reported(spark):
    files = spark.createDataFrame([("file:/no/such/file.csv", "pos/dt=1/file.csv")], "path string, key string")
    row = arrival.manifest(landing.read_heads(files)).first()
    assert row.status == "failed" and row.reason and row.target_key is None


def test_second_run_adds_nothing(spark, tmp_path):
    zone, manifest = str(tmp_path / "landing"), str(tmp_path / "manifest")
    put(zone, {"pos/dt=1/a.csv": POS + "\n1\n", "pos/dt=1/b.csv": ""})
    assert read_manifest(spark, manifest).isEmpty()
    assert arrival_job(spark, zone, manifest).count() == 2
    assert arrival_job(spark, zone, manifest).count() == 2
    put(zone, {"pos/dt=1/b.csv": POS + "\n2\n", "pos/dt=2/c.csv": POS})
    again = arrival_job(spark, zone, manifest)
    assert sorted((row.key, row.status) for row in again.collect()) == [
        ("pos/dt=1/a.csv", "accepted"), ("pos/dt=1/b.csv", "accepted"), ("pos/dt=1/b.csv", "quarantined"),
        ("pos/dt=2/c.csv", "quarantined"),
    ]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    zone, manifest, offsets = (str(tmp_path / name) for name in ("landing", "manifest", "offsets"))
    put(zone, {key: content for key, (content, _) in FILES.items() if "09-17" in key})
    watch_landing(spark, zone, manifest, offsets).awaitTermination()
    put(zone, {key: content for key, (content, _) in FILES.items() if "09-17" not in key})
    watch_landing(spark, zone, manifest, offsets).awaitTermination()
    watch_landing(spark, zone, manifest, offsets).awaitTermination()
    batch = {(row.key, row.reason) for row in check_landing(spark, zone).collect()}
    stream = [(row.key, row.reason) for row in read_manifest(spark, manifest).collect()]
    assert len(stream) == len(set(stream)) and set(stream) == batch


def test_only_rows_of_accepted_files(spark, tmp_path):
    zone = str(tmp_path / "a b")
    line = "t,S001,ON,09/17/2026,TH1,x,Packs,1,1.00,cash,\n"
    put(zone, {
        "pos/dt=2026-09-17/a.csv": POS + "\n" + line, "pos/dt=2026-09-17/b.csv": "x" + POS + "\n" + line * 2,
        "pos/dt=2026-09-18/c d.csv": POS + "\n" + line,
    })
    accepted = accepted_paths(spark, zone, check_landing(spark, zone))["pos"]
    kept = raw.read_pos(spark, zone + "/pos", check_header=False, paths=[path for _, path in accepted])
    assert sorted(row.dt for row in kept.collect()) == ["2026-09-17", "2026-09-18"]
    with pytest.raises(Exception, match="header does not conform"):
        raw.read_pos(spark, zone + "/pos").collect()


def test_last_verdict_counts(spark, tmp_path):
    zone, manifest = str(tmp_path / "landing"), str(tmp_path / "manifest")
    put(zone, {"pos/dt=1/a.csv": POS + "\n1\n", "pos/dt=1/b.csv": POS})
    arrival_job(spark, zone, manifest)
    put(zone, {"pos/dt=1/a.csv": POS, "pos/dt=1/b.csv": POS + "\n22\n"})
    accepted = accepted_paths(spark, zone, arrival_job(spark, zone, manifest))
    assert [path.rsplit("/", 1)[1] for _, path in accepted["pos"]] == ["b.csv"]


def test_sending(spark, tmp_path):
    folder, zone = str(tmp_path / "out"), str(tmp_path / "landing")
    put(folder, {
        "pos_2026-09-30.csv": "a,b\n1,2\n", "pos_2026-10-01.CSV": "", "pos_2026-10-02.csv": "a,b\n",
        "none.csv": "a,b\n\n", "pos_2026-10-03.csv": "\nx\n", "pos_2026-10-04.csv": b"\xff\n",
        "customers_20260928.txt": "a,b\n1\n", "c_2026-09-21.txt": "a|b\n1|2\n",
        "o_2026-09-17.json": "{}\n", "p_2026-09-17.json": "x\n", "q_2026-09-17.json": '{"orderId":1,"items":1}',
    })
    put(zone, {"pos/dt=2026-09-30/pos_2026-09-30.csv": "a,b\n1,2\n", "pos/dt=2026-10-02/pos_2026-10-02.csv": "longer than that"})
    plan = sending_plan(spark, folder, zone, "csv")
    got = {row.file_name: (row.key, row.problem, row.status) for row in plan.collect()}
    assert got == {
        "pos_2026-09-30.csv": ("pos/dt=2026-09-30/pos_2026-09-30.csv", None, "skipped"),
        "pos_2026-10-01.CSV": ("pos/dt=2026-10-01/pos_2026-10-01.CSV", "file is empty", "uploaded"),
        "pos_2026-10-02.csv": ("pos/dt=2026-10-02/pos_2026-10-02.csv", "header only, no data rows", "uploaded"),
        "none.csv": ("pos/undated/none.csv", None, "uploaded"),
        "pos_2026-10-03.csv": ("pos/dt=2026-10-03/pos_2026-10-03.csv", "no header row", "uploaded"),
        "pos_2026-10-04.csv": ("pos/dt=2026-10-04/pos_2026-10-04.csv", "cannot be read as CSV", "uploaded"),
    }
    put(folder, {"long_2026-10-05.json": '{"orderId":1,"items":["' + "x" * LIMIT + '"]}\n', "cr_2026-10-06.csv": b"a,b\r1,2\r"})
    assert {r.problem for kind in ("json", "csv") for r in sending_plan(spark, folder, None, kind).collect()
            if r.file_name[:2] in ("lo", "cr")} == {None}
    for name in ("long_2026-10-05.json", "cr_2026-10-06.csv"):
        os.remove(os.path.join(folder, name))
    assert arrival.sending_summary(plan).first().asDict() == dict(uploaded=5, skipped=1, flagged=4, failed=0)
    psv = {row.file_name: row.problem for row in sending_plan(spark, folder, None, "psv").collect()}
    assert psv == {"customers_20260928.txt": "header does not use the '|' delimiter", "c_2026-09-21.txt": None}
    json = {row.file_name: row.problem for row in sending_plan(spark, folder, None, "json").collect()}
    assert json == {
        "o_2026-09-17.json": "first line has no orderId or items", "p_2026-09-17.json": "first line is not valid JSON",
        "q_2026-09-17.json": None,
    }


def test_summary(spark, zone):
    got = {(row.source, row.status): row.files for row in
           arrival.arrival_summary(check_landing(spark, zone)).groupBy("source", "status").agg(F.sum("files").alias("files")).collect()}
    assert got == {
        ("pos", "accepted"): 8, ("pos", "quarantined"): 9, ("ecommerce", "accepted"): 3, ("ecommerce", "quarantined"): 9,
        ("customers", "accepted"): 1, ("customers", "quarantined"): 1,
    }
