"""Schemas of the tables that the operators work on."""

from __future__ import annotations

GROUPS = "contig string, part int, ref string, orientation string, query_start bigint, query_end bigint, aligned_bp bigint, identity_bp double, segment_count bigint, first_start bigint, last_end bigint, blocks bigint, discordant_bp double, changes bigint"
NOVELTY = "query string, novel_ref_bp bigint, novel_ref_frac double, accepted boolean"
BEST_OVERLAP = "query string, overlap_best_contig string, overlap_best_bp bigint"
