"""Command line: segments (and turns) as JSON lines to subtitles or paragraphs.

Exit codes: 2 bad input, 4 failed pipeline, 5 output that can't be written.
"""

from __future__ import annotations

import argparse
import os
import sys

from talktide import lexicons as L


def positive(value: str) -> int:
    n = int(value)
    if n < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


def threads(asked: int | None) -> int:
    """An explicit number, else OMP_NUM_THREADS, else the processors this process may use."""
    if asked:
        return asked
    given = os.environ.get("OMP_NUM_THREADS", "")
    return int(given) if given.isdigit() and int(given) else max(1, len(os.sched_getaffinity(0)))


def language(code: str | None) -> str | None:
    """Unknown codes pass: the lists of the engine are not those of a recogniser."""
    if code and code not in L.LANGUAGES:
        print(f"language {code} is not in the list; it is used as it is", file=sys.stderr)
    return None if code in (None, "auto") else code


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="talktide", description=__doc__.splitlines()[0])
    p.add_argument("segments")
    p.add_argument("--turns")
    p.add_argument("--output_dir", required=True)
    p.add_argument("--language", default="en")
    p.add_argument("--output_format", choices=["txt", "srt"], default="txt")
    p.add_argument("--cpu-threads", type=positive)
    p.add_argument("--dump-merge-metadata", action="store_true")
    return p


def main(args: list[str] | None = None) -> int:
    from pyspark.errors import PySparkException

    from talktide.plans.transcript import transcribe
    from talktide.session import session
    from talktide.sources import readers, sinks

    asked = parser().parse_args(args)
    # a number of threads asks for this machine; else spark-submit's master stands, as on a cluster
    spark = session(master=f"local[{threads(asked.cpu_threads)}]" if asked.cpu_threads or not os.environ.get("SPARK_ENV_LOADED") else None)
    try:
        segments = readers.segments_json(spark, asked.segments)
        turns = readers.turns_json(spark, asked.turns) if asked.turns else None
    except PySparkException as e:
        print(e, file=sys.stderr)
        return 2
    try:
        found = transcribe(segments, turns, language(asked.language) or "en", asked.output_format)
    except PySparkException as e:
        print(e, file=sys.stderr)
        return 4
    try:
        sinks.write_text(found.output, f"{asked.output_dir}/{asked.output_format}")
        if asked.dump_merge_metadata and found.history is not None:
            found.history.write.mode("overwrite").json(f"{asked.output_dir}/merges")
    except PySparkException as e:
        print(e, file=sys.stderr)
        return 5
    return 0


if __name__ == "__main__":
    sys.exit(main())
