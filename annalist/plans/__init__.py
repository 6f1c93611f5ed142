"""All queries of the library and, where SQL can say the same, their SQL."""

from annalist.plans import desk, intake, log, matching, panels, papers, reads, rules, vault

QUERIES = log.QUERIES | papers.QUERIES | panels.QUERIES | rules.QUERIES | desk.QUERIES | intake.QUERIES | matching.QUERIES | vault.QUERIES | reads.QUERIES
SQL = log.SQL | papers.SQL | panels.SQL | rules.SQL | desk.SQL | intake.SQL | matching.SQL | vault.SQL | reads.SQL
