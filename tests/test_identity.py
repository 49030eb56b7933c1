import random

from leadflow.operators import identity


def test_days_added_equal_the_whole_rebuilt(spark):
    rng = random.Random(11)
    rows = []
    for i in rng.sample(range(1000, 2000), 240):
        company = rng.choice(["E1", "E2"])
        for kind, n in (("PHONE", 60), ("EMAIL", 90), ("SOURCE_LEAD_ID", 150)):
            if rng.random() < 0.6:
                rows.append((str(i), f"L{i % 7}", company, kind, f"{kind}{rng.randrange(n)}"))
    rows.append(("1", "L", "E1", "PHONE", "PHONE1"))  # a small key that comes late
    rows.append(("2", "L", None, "EMAIL", "EMAIL1"))  # no company: links nobody
    signals = lambda rs: spark.createDataFrame(rs, "raw_row_id string, lead_id string, empresa_id string, signal_type string, signal_value string")
    leads = spark.createDataFrame([(r, l, "web" if int(r) % 2 else None) for r, l in {(r[0], r[1]) for r in rows}], "raw_row_id string, lead_id string, canal_normalizado string")
    order = sorted({r[0] for r in rows} - {"1"}, key=lambda r: rng.random()) + ["1"]
    days = [order[:150], order[150:] + ["3000"]]
    rows.append(("3000", "L", "E2", "PHONE", "nobody else"))
    rows.append((order[0], "L", "E2" if next(r for r in rows if r[0] == order[0])[2] == "E2" else "E1", "PHONE", "nobody else"))  # a known row comes again
    leads = leads.unionByName(spark.createDataFrame([("3000", "L", "web")], leads.schema))
    seen = [r for r in rows if r[0] in days[0] and r[4] != "nobody else"]
    known, table = identity.identity_components(signals(seen)), {r["raw_row_id"]: r for r in identity.lead_identity_map(leads, signals(seen)).collect()}
    for day in days[1:]:
        new = [r for r in rows if r not in seen]
        holders = identity.signal_holders(signals(seen))
        added, moved = identity.grow_components(known, holders, signals(new))
        seen = seen + new
        known = spark.createDataFrame(identity.extend_components(known, added, moved).collect(), "raw_row_id string, component_key string")
        assert {tuple(r) for r in known.collect()} == {tuple(r) for r in identity.identity_components(signals(seen)).collect()}
        changed = identity.extend_identity_map(known, added, leads, signals(seen)).collect()
        table |= {r["raw_row_id"]: r for r in changed}
        whole = {r["raw_row_id"]: r for r in identity.lead_identity_map(leads, signals(seen)).collect()}
        assert table == whole and len(changed) < len(whole)
