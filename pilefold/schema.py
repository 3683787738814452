"""Schemas of the relations, as DDL."""

READS = "sample string, file_order long, query_name string, flag int, chrom string, ref_start long, ref_end long, mapq int, cigar string, seq string, quals array<int>"
REFERENCE = "chrom string, block_start long, seq string"
CONTIGS = "chrom string, length long"
REGIONS = "chrom string, start long, end long"
CANDIDATES = "chrom string, pos long"
PREDICTIONS = "chrom string, pos long, pred_true double"
TENSOR = "chrom string, pos long, data array<float>"
