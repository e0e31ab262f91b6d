"""Fixed schemas; nothing is inferred on reading."""

PIXELS = "sample string, resolution int, chrom1_idx int, bin1 bigint, chrom2_idx int, bin2 bigint, count bigint"
CHROMSIZES = "chrom_idx int, chrom string, length bigint"
BINS = "resolution int, bin_id bigint, chrom_idx int, local_bin bigint, start bigint, end bigint, weight double"
SV_CALLS = "chr string, label string, start bigint, end bigint"
WIDE_CALLS = "chrom1 string, pos1 bigint, chrom2 string, pos2 bigint, `++` double, `+-` double, `-+` double, `--` double"
RESULTS = "bp_1 bigint, bp_2 bigint, label string"
EXPECTED = "dist bigint, n_valid bigint, balanced_sum double"
EXPECTED_TRANS = "n_valid bigint, balanced_sum double"
ALIGNMENT = "type string, achr string, astart bigint, aend bigint, bstart bigint, bend bigint"
MANIFEST = "sample_id string, clean_id string, truth_id string, split string"
