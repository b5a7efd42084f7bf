"""Command line: ``filter`` for elementary streams, ``frames`` for raw video, ``presets`` for the catalogue.

    python -m frameloom filter --recover-every 3 --splice-slice-every=2 --donor other.h264 in.h264 out
    python -m frameloom frames --backend motion --preset melt --width 640 --height 360 --set mv_jitter=3 in.rgb out

Inputs are files or folders that Spark reads, a stream each; outputs are Parquet folders. Exit codes: 0 done, 1 the
run failed, 2 the arguments are wrong.
"""

from __future__ import annotations

import argparse
import math
import sys
from pathlib import Path

from frameloom.plans.params import DEFAULTS, PRESETS, Controls
from frameloom.plans.presets import FILTER_DEFAULTS

CODECS = {"h264": "h264", "avc": "h264", "hevc": "hevc", "h265": "hevc", "mpeg4": "mpeg4", "mpeg1": "mpeg1", "mpeg2": "mpeg2"}
#: Choices of settings that are words.
WORDS = {"codec": CODECS, "drop_mpeg_slice_address_mode": {m: m for m in ("all", "key", "predicted")}, "rewrite_frame_type_to": {t: t for t in "ipbsd"}}


def word(options: dict[str, str]):
    def parse(text: str) -> str:
        if text.lower() not in options:
            raise argparse.ArgumentTypeError(f"{text!r} is none of {', '.join(options)}")
        return options[text.lower()]

    return parse


def count(text: str) -> int:
    value = int(text)
    if value < 0:
        raise argparse.ArgumentTypeError(f"{text} is under 0")
    return value


def finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise argparse.ArgumentTypeError(f"{text} is not finite")
    return value


def assignment(text: str) -> tuple[str, float]:
    name, sign, value = text.partition("=")
    if not sign:
        raise argparse.ArgumentTypeError(f"{text!r} is not name=value")
    return name.strip(), finite(value)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="frameloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    kinds = top.add_subparsers(dest="kind", required=True)
    f = kinds.add_parser("filter", help="rules over an elementary stream")
    for name, default in FILTER_DEFAULTS.items():
        option = "--" + name.replace("_", "-")
        if isinstance(default, bool):
            f.add_argument(option, action="store_true")
        else:
            f.add_argument(option, default=default, type=word(WORDS[name]) if name in WORDS else int if name == "shift_slice_address_by" else count)
    f.add_argument("--donor", help="a file whose predicted units fill the donor bank")
    v = kinds.add_parser("frames", help="a codec over raw frames")
    v.add_argument("--backend", required=True, choices=sorted(DEFAULTS))
    v.add_argument("--preset", default="clean")
    v.add_argument("--width", type=count, required=True)
    v.add_argument("--height", type=count, required=True)
    v.add_argument("--permissive", action="store_true", help="leave out a partial last frame instead of failing")
    v.add_argument("--set", action="append", default=[], type=assignment, metavar="NAME=VALUE")
    for name in Controls.__dataclass_fields__:
        v.add_argument(f"--{name}", type=finite, default=1.0)
    for p in (f, v):
        p.add_argument("input")
        p.add_argument("output")
    kinds.add_parser("presets", help="list the presets")
    return top


def main(arguments: list[str] | None = None, spark=None) -> int:
    try:
        a = parser().parse_args(arguments)
    except SystemExit as e:
        return int(e.code or 0)
    if a.kind == "presets":
        for backend, presets in PRESETS.items():
            print(f"{backend}: {', '.join(p[0] for p in presets)}")
        return 0
    try:
        from pyspark.sql import SparkSession
        from pyspark.sql import functions as F

        from frameloom.session import ship_package

        spark = spark or SparkSession.builder.appName("frameloom").getOrCreate()
        ship_package(spark)
        if a.kind == "filter":
            from frameloom.operators.unit_filter import filter_streams

            settings = {name: getattr(a, name) for name in FILTER_DEFAULTS}
            donor = Path(a.donor).read_bytes() if a.donor else b""
            chunks = spark.read.format("binaryFile").load(a.input).select(F.col("path").alias("stream_id"), F.lit(0).cast("long").alias("chunk_no"), F.col("content").alias("bytes"))
            out = filter_streams(chunks, donor, **settings)
        else:
            from frameloom.plans.engine import Engine
            from frameloom.sources.frames import raw_frames

            engine = Engine(a.backend, a.width, a.height).set_preset(a.preset).set_controls(**{c: getattr(a, c) for c in Controls.__dataclass_fields__})
            for name, value in getattr(a, "set"):
                engine.set_parameter(name, value)
            out = engine.process(raw_frames(spark, a.input, a.width, a.height, strict=not a.permissive))
        out.write.mode("overwrite").parquet(a.output)
    except Exception as e:
        print(f"frameloom: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
