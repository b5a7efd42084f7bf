"""The unit rules against known bytes, and the streaming form against the batch form."""

import random

import pytest

from frameloom.operators import unit_filter as uf

P, K = "00000141", "00000165"


def run(units, **settings):
    out, _ = uf.run_units([bytes.fromhex("".join(units).replace(" ", ""))], **settings)
    return [u.hex() for u in out]


@pytest.mark.parametrize(
    ("units", "settings", "want"),
    [
        ([K + "01", P + "02", K + "03"], {}, [K + "01", P + "02"]),
        ([K + "01", K + "02", K + "03"], {"recover_every": 2}, [K + "01", K + "03"]),
        ([P + "01", P + "02", P + "03"], {"drop_slice_every": 2}, [P + "01", P + "03"]),
        ([P + "01", P + "02"], {"repeat_slice_every": 2, "repeat_count": 2}, [P + "01", P + "02", P + "02", P + "02"]),
        ([P + "01020304"], {"truncate_slice_every": 1, "truncate_amount": 2}, [P + "0102"]),
        ([P + "0102030405"], {"rotate_slice_every": 1, "rotate_amount": 4}, [P + "0105020304"]),
        ([P + "0a0b0c0d", P + "01020304"], {"splice_slice_every": 2, "splice_amount": 2}, [P + "0a0b0c0d", P + "0c0d0304"]),
        ([P + "0a0b0c0d", P + "01020304"], {"grow_slice_every": 2, "grow_amount": 2}, [P + "0a0b0c0d", P + "01020c0d0304"]),
        ([P + "0102", P + "0408"], {"xor_slice_every": 2, "xor_amount": 2}, [P + "0102", P + "050c"]),
        ([P + "01", P + "02"], {"echo_slice_every": 2}, [P + "01", P + "01", P + "02"]),
        ([P + "01", P + "02"], {"replace_slice_every": 2}, [P + "01", P + "01"]),
        (["000001b60001"], {"codec": "mpeg4", "drop_idr_after": 99, "rewrite_frame_type_every": 1, "rewrite_frame_type_to": "b"}, ["000001b68001"]),
        (["000001000010"], {"codec": "mpeg2", "drop_idr_after": 99, "rewrite_frame_type_every": 1, "rewrite_frame_type_to": "b"}, ["000001000018"]),
        (["000001000008", "0000010155", "000001000010", "0000010455"], {"codec": "mpeg2", "drop_idr_after": 9, "shift_slice_address_every": 1, "shift_slice_address_by": 2}, ["000001000008", "0000010355", "000001000010", "0000010655"]),
        (["000001000008", "0000010155"], {"codec": "mpeg2", "shift_slice_address_every": 1, "shift_slice_address_by": -1}, ["000001000008", "000001af55"]),
        (["0000014001", "0000014201", "0000014401"] * 2, {"codec": "hevc", "drop_headers_after_first": True}, ["0000014001", "0000014201", "0000014401"]),
    ],
)
def test_known_bytes(units, settings, want):
    assert run(units, **settings) == want


def test_donor_and_chunk_boundaries():
    out, counts = uf.run_units([bytes.fromhex(P + "01020304")], donor=bytes.fromhex(P + "0a0b0c0d"), donor_splice_slice_every=1, donor_splice_amount=2)
    assert out[0].hex() == P + "0a0b0304" and counts["donor_spliced"] == 1
    out, _ = uf.run_units([bytes.fromhex(c) for c in ("0000", "01670100", "00014102")], drop_idr_after=99)
    assert [u.hex() for u in out] == ["0000016701", "0000014102"]
    with pytest.raises(ValueError, match="no such setting"):
        uf.StreamState.of(nonsense=1)


def test_chunks_do_not_matter():
    rng = random.Random(1)
    data = b"junk" + b"".join(bytes.fromhex(rng.choice(("000001", "00000001")) + rng.choice(("41", "65", "67", "68"))) + rng.randbytes(rng.randint(0, 9)) for _ in range(200))
    settings = dict(recover_every=3, damage_slice_every=2, scramble_slice_every=3, xor_slice_every=5, grow_slice_every=4, echo_slice_every=7)
    whole, counts = uf.run_units([data], **settings)
    at = sorted(rng.sample(range(len(data)), 60))
    parts = [data[a:b] for a, b in zip([0, *at], [*at, len(data)])]
    assert uf.run_units(parts, **settings) == (whole, counts) and counts["damaged"]


def test_batch_and_streaming_agree(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for s in range(3):
        data = b"".join(bytes.fromhex("00000141") + rng.randbytes(6) for _ in range(40))
        cuts = [0, 50, 121, 300, len(data)]
        rows += [(f"s{s}", i, data[a:b], i == 3) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    schema = "stream_id string, chunk_no long, bytes binary, last boolean"
    settings = dict(splice_slice_every=2, drop_slice_every=5)
    batch = {(r.stream_id, r.seq): bytes(r.data) for r in uf.filter_streams(spark.createDataFrame(rows, schema).repartition(5), **settings).collect()}
    for i in range(4):
        spark.createDataFrame([r for r in rows if r[1] == i], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from frameloom.streaming.units import filter_stream

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = filter_stream(stream, **settings).writeStream.format("memory").queryName("units_out").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.stream_id, r.seq): bytes(r.data) for r in spark.table("units_out").collect()} == batch and len(batch) == 3 * 32
