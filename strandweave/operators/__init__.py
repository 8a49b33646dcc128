"""DataFrame to DataFrame steps of haplotype reconstruction.

Frames: ``records`` (contig, rec_ord, pos, ref, alt, format, samples), ``ref_tiles`` (contig,
tile_id, seq), ``ref_contigs`` (contig, contig_ord, length), ``samples`` (sample_idx, sample).
"""
