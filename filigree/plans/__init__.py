"""The library's queries on the driver's tables, with SQL that must give the same rows."""

from filigree.plans import audits, filings, graph, ingest, manifests, matching, migration, names, network, outside, resolution, risk_families, searches, triage, whole_filings

MODULES = (filings, names, network, ingest, risk_families, searches, audits, resolution, graph, migration, matching, whole_filings, manifests, triage, outside)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: s for m in MODULES for name, s in m.ORACLES.items()}
