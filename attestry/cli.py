"""Command line: ``python -m attestry.cli verify LOG | diff BEFORE AFTER | annotate RECORDS OUT``.

Exit codes: 0 all is well, 1 a check failed, 2 wrong use.
"""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    from .operators import annotate, audit, organize, snapshots
    from .sources import files

    if not args or args[0] not in ("verify", "diff", "annotate") or len(args) < (2 if args[0] == "verify" else 3):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    if args[0] == "verify":
        bad = audit.verify(files.read_audit(spark, args[1]), strict=True).where("not valid").limit(1).collect()
        print("invalid" if bad else "valid")
        return int(bool(bad))
    if args[0] == "diff":
        worse = [r.metric for r in snapshots.compare(files.read_snapshot(spark, args[1]), files.read_snapshot(spark, args[2])).where("regressed").collect()]
        print("\n".join(worse) or "no regression")
        return int(bool(worse))
    files.write_records(organize.dedup(annotate.annotate(files.read_records(spark, args[1])).withColumn("input_seq", files.F.monotonically_increasing_id())), args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
