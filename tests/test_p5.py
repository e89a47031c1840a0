"""Image metadata of dispatchers as flat rows."""

import json

from morphoquarry.plans.p5 import QUERIES


def test_image_metadata_is_whole(spark, tmp_path):
    metas = [{"shape": [1, 2], "ch_wavelengths": {"0": 488, "1": 561}, "zooms": [1, 0.5]}, json.dumps({"mag": 40, "ch_wavelengths": '{"0": 640}', "zooms": 2.5}), {"ch_wavelengths": [], "zooms": None}, None]
    payload = json.dumps({"dispatcher_configs": [{"ex_i": f"e{i}", "exmd": {"image_metadata": m}} for i, m in enumerate(metas)]})
    spark.createDataFrame([(1, payload)], "run_id long, payload string").write.parquet(f"{tmp_path}/quant_runs.parquet")
    got = {r.disp_i: r for r in QUERIES["p5_image_metadata"](spark, str(tmp_path)).collect()}
    parsed = {i: [None if v is None else json.loads(v) for v in (r.ch_wavelengths, r.zooms)] for i, r in got.items()}
    assert parsed == {0: [{"0": 488, "1": 561}, [1, 0.5]], 1: [{"0": 640}, 2.5], 2: [[], None], 3: [None, None]}
    assert got[1].mag == 40 and json.loads(got[0].shape) == [1, 2]
