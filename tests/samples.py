"""Small frames with known results."""

RETAILER_SCHEMA = (
    "retailer_id string, retailer_name string, state string, district string, tehsil string, week string, "
    "avg_weekly_revenue double, days_since_last_visit int, stockout_events int, avg_depletion_rate double, "
    "weeks_of_stock double"
)
# Revenue spans 10000..60000, days 2..22, stockouts 0..10, depletion 300..700, so the
# normalised values are round and the scores below can be checked by hand.
RETAILERS = [
    ("K11", "Alder", "QA", "Velm", "Orrin", "2031-W07", 60000.0, 2, 1, 300.0, 6.5),
    ("K12", "Birch", "QB", "Sorra", "Pelt", "2031-W07", 20000.0, 12, 4, 500.0, 1.5),
    ("K13", "Cedar", "QC", "Tarn", "Lower", "2031-W07", 10000.0, 22, 8, 700.0, 2.0),
    ("K14", "Dogwood", "QA", "Quill", "Marsh", "2031-W07", 35000.0, 7, 0, 400.0, 9.0),
    ("K15", "Elm", "QD", "Brask", "Upper", "2031-W07", 50000.0, 17, 10, 600.0, 1.9),
    ("K11", "Alder", "QA", "Velm", "Orrin", "2031-W07", 60000.0, 2, 1, 300.0, 6.5),
]
RETAILER_GOLDEN = {  # score, urgency, tier
    "K11": (0.32, "ROUTINE", "HIGH"),  # 0.30 + 0 + 0.02 + 0 + 0
    "K12": (0.465, "URGENT", "MID"),  # 0.06 + 0.125 + 0.08 + 0.15 + 0.05; stock below 2 weeks
    "K13": (0.51, "SOON", "LOW"),  # 0 + 0.25 + 0.16 + 0 + 0.10
    "K14": (0.2375, "ROUTINE", "MID"),  # 0.15 + 0.0625 + 0 + 0 + 0.025
    "K15": (0.8525, "URGENT", "HIGH"),  # 0.24 + 0.1875 + 0.20 + 0.15 + 0.075
}

DISTRICT_SCHEMA = (
    "district string, state string, date string, precip_mm_7d double, avg_humidity_pct double, "
    "total_pest_alerts int, high_incidence_count int, fungicide_risk_flag int"
)
# At most 40 alerts; one district per product rule.
DISTRICTS = [
    ("Velm", "QA", "2031-02-14", 1.0, 85.0, 10, 3, 1),
    ("Sorra", "QB", "2031-02-14", 6.0, 50.0, 4, 2, 0),
    ("Tarn", "QC", "2031-02-14", 9.0, 60.0, 16, 14, 0),
    ("Quill", "QA", "2031-02-14", 2.0, 90.0, 20, 10, 0),
    ("Brask", "QD", "2031-02-14", 0.5, 45.0, 40, 9, 0),
]
DISTRICT_GOLDEN = {  # score, tier, product
    "Velm": (0.7375, "HIGH", "Score 250 EC"),  # 0.0875 + 0.30 + 0.20 + 0.15
    "Sorra": (0.035, "LOW", "Monitor Digital Demand"),
    "Tarn": (0.14, "LOW", "Actara 25 WG"),
    "Quill": (0.375, "MEDIUM", "Monitor Digital Demand"),  # 0.175 + 0.20
    "Brask": (0.5, "MEDIUM", "Topik 15 WP"),  # 0.35 + 0.15
}
