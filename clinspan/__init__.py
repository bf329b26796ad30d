"""Clinical record linkage, de-identification, CDM mapping, cohorts and note extraction on Spark."""
