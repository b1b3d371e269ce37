from __future__ import annotations


def test_recommended_conf_scales_with_input():
    from tierlift.session import recommended_conf
    small = recommended_conf(10 << 30, 64)
    big = recommended_conf(100 << 40, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 192          # 3 x cores floor
    assert int(big["spark.sql.shuffle.partitions"]) > 200_000          # ~40 TB shuffled / 192 MB
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_cli_writes_all_reports(spark, tmp_path):
    from tierlift.__main__ import main
    from tierlift.plans.experiment import Experiment
    assert main(["--tpch", "/root/testdata/sf0.001", "--out", str(tmp_path)]) == 0
    import os
    scratch = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(scratch))
    names = {*Experiment.REPORTS, *Experiment.FINANCE}
    assert len(names) == 22 and {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {f"{n}.csv" for n in names}
    assert main(["--tpch", "/root/testdata/sf0.001", "--out", str(tmp_path / "one"), "--reports", "engagement"]) == 0
    assert (tmp_path / "one" / "engagement.csv").read_text() == (tmp_path / "engagement.csv").read_text()
    assert set(os.listdir(scratch)) == before  # scratch folders go with the run


def test_cli_on_csv_with_other_names_and_windows(spark, tmp_path):
    """Tables with the column names and dates of a 2022-2024 export."""
    import csv
    import datetime as dt

    from tierlift.__main__ import main
    from tierlift.config import ExperimentConfig
    from tierlift.plans.experiment import Experiment
    from tierlift.sources import read_transactions, read_users

    users, tx = tmp_path / "users.csv", tmp_path / "transactions.csv"
    with users.open("w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["user_crm_id", "city", "user_gender", "registration_date", "opt_in_status", "is_member", "loyalty_tier"])
        for i in range(1, 121):
            member = i % 2 == 0
            w.writerow([f"{i}.0", f"city{i % 5}", "FM"[i % 2], "2020-01-01", i % 11 != 0, member,
                        ["Bronze", "Silver", "Gold", "Platinum"][i % 8 // 2] if member else ""])
    with tx.open("w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["date", "user_crm_id", "transaction_id", "transaction_coupon", "transaction_revenue"])
        for i in range(1, 121):
            for k in range(1 + i % 5):
                w.writerow([f"2023-0{1 + k}-15", i, f"T-{i}-{k}", "", "10.50"])
            for k in range(i % 3):
                w.writerow([f"2024-0{1 + k}-20", i, f"P-{i}-{k}", ["PFX-7", "SALE", ""][(i + k) % 3], f"{20 + i}.25"])
    user_names = {"user_crm_id": "user_id", "user_gender": "gender", "opt_in_status": "opt_in", "loyalty_tier": "member_tier"}
    tx_names = {"date": "txn_date", "user_crm_id": "user_id", "transaction_id": "txn_id", "transaction_coupon": "coupon",
                "transaction_revenue": "revenue"}
    flat = lambda d: ",".join(f"{a}={b}" for a, b in d.items())
    out = tmp_path / "out"
    assert main(["--users", str(users), "--transactions", str(tx), "--format", "csv", "--user-columns", flat(user_names),
                 "--transaction-columns", flat(tx_names), "--pre", "2022-01-01:2023-12-31", "--launch", "2024-01-01",
                 "--post", "2024-01-01:2024-12-31", "--coupon-prefix", "PFX-", "--referral-label", "PFX",
                 "--out", str(out)]) == 0
    day = dt.date.fromisoformat
    cfg = ExperimentConfig(pre_start=day("2022-01-01"), pre_end=day("2023-12-31"), launch=day("2024-01-01"),
                           post_start=day("2024-01-01"), post_end=day("2024-12-31"), coupon_prefix="PFX-", referral_label="PFX")
    ex = Experiment(read_users(spark, str(users), "csv", user_names), read_transactions(spark, str(tx), "csv", tx_names), cfg)
    for name, report in ex.reports((*Experiment.REPORTS, *Experiment.FINANCE)).items():
        want = [[str(v).lower() if isinstance(v, bool) else str(v) if v is not None else "" for v in r] for r in report.collect()]
        got = list(csv.reader((out / f"{name}.csv").open()))
        assert got[0] == report.columns and sorted(got[1:]) == sorted(want) and want, name


def test_cli_rejects_and_text_ids(spark, tmp_path, capsys):
    from tierlift.__main__ import main
    users, tx = tmp_path / "users.csv", tmp_path / "transactions.csv"
    users.write_text("user_id,city,gender,registration_date,opt_in,is_member,member_tier\n" + "".join(
        f"C-{i:04},A,F,1990-01-01,true,{'true' if i % 2 else 'false'},Bronze\n" for i in range(40)) + "C-9999,short\n")
    tx.write_text("txn_date,user_id,txn_id,coupon,revenue\n" + "".join(
        f"{day},C-{i:04},{day}-{i},FRIEND-C-0001,5.00\n" for i in range(40) for day in ("1997-05-05", "1998-05-05"))
        + "1997-05-05,C-0001,T,,five\n1997-05-05,C-0001,T,,5.00,6\n")
    options = ["--users", str(users), "--transactions", str(tx), "--format", "csv", "--text-ids", "--out", str(tmp_path / "out")]
    assert main([*options, "--rejects", str(tmp_path / "rejects"), "--reports", "balanced_group_sizes,referrals_by_referrer"]) == 0
    said = capsys.readouterr().out
    assert "rejected users\t1\t" in said and "rejected transactions\t2\t" in said
    assert (tmp_path / "out" / "balanced_group_sizes.csv").read_text().split() == ["tier_label,user_count", "Bronze,20", "bronze_control,20"]
    assert "C-0001,true,39,39" in (tmp_path / "out" / "referrals_by_referrer.csv").read_text()


def test_tier_file(tmp_path):
    import json

    from tierlift.__main__ import config_of, parser
    path = tmp_path / "tiers.json"
    path.write_text(json.dumps([{"name": "One", "control_label": "one_ctl", "min_orders": 1, "max_orders": None,
                                 "discount_rate": 0.125, "sort_order": 1}]))
    cfg = config_of(parser().parse_args(["--out", "x", "--tiers", str(path)]))
    assert cfg.tier_names == ["One"] and cfg.repricing == ()
