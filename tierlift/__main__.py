"""Run the eight analyses and fourteen finance tables; one headed CSV file each.

    python -m tierlift --users PATH --transactions PATH --out DIR [--format csv]
        [--user-columns source=user_id,...] [--transaction-columns source=txn_id,...]
        [--pre FROM:TO] [--launch DATE] [--post FROM:TO] [--coupon-prefix TEXT]
        [--referral-label TEXT] [--tiers FILE] [--reports NAME,...] [--text-ids]
        [--rejects DIR]
    python -m tierlift --tpch /root/testdata/sf0.1 --out DIR [--grain line]

Dates are ISO dates, windows are closed on both ends.  ``--tiers`` names a JSON
list of objects with the fields ``name, control_label, min_orders, max_orders,
discount_rate, sort_order``.  ``--reports`` names reports, ``analyses`` or
``finance`` (else all).  A row that cannot be read ends the run, or goes to
``DIR/users`` or ``DIR/transactions`` with ``--rejects DIR``.  On a cluster, run it through ``spark-submit`` with
the package on the Python path; master, ``spark.checkpoint.dir`` and partition
settings come from the submitting environment.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import SparkSession

from .config import DEFAULT_CONFIG, ExperimentConfig, Tier
from .plans.experiment import Experiment
from .session import scratch_scope
from .sources.readers import read_transactions, read_users, rejected


def _columns(text: str) -> dict[str, str]:
    pairs = [p.split("=", 1) for p in text.split(",") if p]
    if any(len(p) != 2 for p in pairs):
        raise argparse.ArgumentTypeError(f"not a list of source=name: {text!r}")
    return {a.strip(): b.strip() for a, b in pairs}


def _window(text: str) -> tuple[dt.date, dt.date]:
    first, _, last = text.partition(":")
    return dt.date.fromisoformat(first), dt.date.fromisoformat(last)


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="tierlift", description=__doc__.splitlines()[0])
    ap.add_argument("--users")
    ap.add_argument("--transactions")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--user-columns", type=_columns, default={}, help="source=name,... of the users table")
    ap.add_argument("--transaction-columns", type=_columns, default={}, help="source=name,... of the transactions table")
    ap.add_argument("--pre", type=_window, help="pre-launch window, FROM:TO")
    ap.add_argument("--launch", type=dt.date.fromisoformat, help="users registered before this day are eligible")
    ap.add_argument("--post", type=_window, help="post-launch window, FROM:TO")
    ap.add_argument("--coupon-prefix", help="prefix of referral codes")
    ap.add_argument("--referral-label", help="name of the referral class in reports")
    ap.add_argument("--tiers", help="JSON file with the tier ladder")
    ap.add_argument("--reports", default="analyses,finance", help="names of reports, 'analyses' or 'finance'")
    ap.add_argument("--text-ids", action="store_true", help="user ids are text, not integers")
    ap.add_argument("--rejects", help="folder for rows that cannot be read (without it they are an error)")
    ap.add_argument("--tpch", help="derive users/transactions from a star-schema directory")
    ap.add_argument("--grain", default="order", choices=["order", "line"])
    ap.add_argument("--out", required=True)
    return ap


def config_of(args: argparse.Namespace) -> ExperimentConfig:
    """The default configuration with what the arguments replace."""
    changes: dict = {}
    if args.pre:
        changes["pre_start"], changes["pre_end"] = args.pre
    if args.post:
        changes["post_start"], changes["post_end"] = args.post
    if args.launch:
        changes["launch"] = args.launch
    if args.coupon_prefix:
        changes["coupon_prefix"] = args.coupon_prefix
    if args.referral_label:
        changes["referral_label"] = args.referral_label
    if args.tiers:
        with open(args.tiers, encoding="utf-8") as f:
            changes["tiers"] = tuple(Tier(**t) for t in json.load(f))
        names = {t.name for t in changes["tiers"]}
        changes["repricing"] = tuple(r for r in DEFAULT_CONFIG.repricing if r[0] in names)
    return DEFAULT_CONFIG.with_(**changes)


def reports_of(text: str) -> tuple[str, ...]:
    """Report names, with ``analyses`` and ``finance`` for all of a kind."""
    groups = {"analyses": Experiment.REPORTS, "finance": Experiment.FINANCE}
    return tuple(dict.fromkeys(r for name in text.split(",") if name for r in groups.get(name.strip(), (name.strip(),))))


def main(argv: list[str] | None = None) -> int:
    ap = parser()
    args = ap.parse_args(argv)
    cfg = config_of(args)
    spark = SparkSession.builder.appName("tierlift").getOrCreate()
    with scratch_scope(spark):  # what reports share is deleted once they are written
        if args.tpch:
            ex = Experiment.from_tpch(spark, args.tpch, cfg, grain=args.grain, materialize=True)
        elif args.users and args.transactions:
            place = {t: f"{args.rejects.rstrip('/')}/{t}" if args.rejects else None for t in ("users", "transactions")}
            ex = Experiment(read_users(spark, args.users, args.format, args.user_columns, text_ids=args.text_ids, rejects=place["users"]),
                            read_transactions(spark, args.transactions, args.format, args.transaction_columns,
                                              text_ids=args.text_ids, rejects=place["transactions"]),
                            cfg, materialize=True)
            if args.rejects:
                for table, path in place.items():
                    print(f"rejected {table}\t{rejected(spark, path)}\t{path}")
        else:
            ap.error("give --tpch, or --users and --transactions")
        for name, path in ex.write_reports(args.out, reports_of(args.reports)).items():
            print(f"{name}\t{path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
