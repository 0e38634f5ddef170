"""Small inputs, rebuilt from their descriptions."""

import gzip


def coords_text(rows, piped=True):
    """rows: (ref, query, s1, e1, s2, e2, identity, ref length, query length)."""
    out = ["/a /b", "NUCMER", "", "    [S1]     [E1]  |  ...", "=" * 40] if piped else ["NUCMER", ""]
    for ref, query, s1, e1, s2, e2, idy, lr, lq in rows:
        n1, n2 = abs(e1 - s1) + 1, abs(e2 - s2) + 1
        if piped:
            out.append(f"{s1:8} {e1:8}  | {s2:8} {e2:8}  | {n1:8} {n2:8}  | {idy:8.2f}  | {lr:8} {lq:8}  | {1.0:8.2f} {2.0:8.2f}  | {ref}\t{query}")
        else:
            out.append("\t".join(map(str, (s1, e1, s2, e2, n1, n2, f"{idy:.2f}", lr, lq, ref, query))))
    return "\n".join(out) + "\n"


def fasta_text(records, width=80):
    return "".join(f">{h}\n" + "".join(s[i : i + width] + "\n" for i in range(0, len(s), width)) for h, s in records)


def write(path, text):
    if str(path).endswith(".gz"):
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)
    return str(path)


def sort_inputs(folder, suffix=""):
    ref = write(folder / f"ref.fa{suffix}", fasta_text([("chr1 one", "A" * 120), ("chr2", "C" * 100)]))
    contigs = [("contigA", "A" * 80), ("contigB x", "T" * 40), ("contigC", "G" * 50 + "A" * 10), ("contigDup", "C" * 70), ("contigNo", "N" * 30)]
    assembly = write(folder / f"assembly.fa{suffix}", fasta_text(contigs))
    rows = [("chr1", "contigA", 1, 80, 1, 80, 99.0, 120, 80), ("chr1", "contigDup", 5, 74, 1, 70, 99.0, 120, 70), ("chr1", "contigB", 81, 120, 1, 40, 98.5, 120, 40), ("chr2", "contigC", 10, 69, 60, 1, 97.0, 100, 60)]
    coords = write(folder / "sample.coords", coords_text(rows))
    return ref, assembly, coords


CHIMERIC = [
    ("chrom02", "contig_04", 1, 20, 1, 20, 100.0, 50, 40),
    ("chrom07", "contig_04", 1, 20, 21, 40, 100.0, 50, 40),
    ("chrom04", "contig_12", 1, 5, 1, 5, 100.0, 50, 40),
    ("chrom05", "contig_12", 1, 30, 6, 35, 100.0, 50, 40),
    ("chrom04", "contig_12", 31, 35, 36, 40, 100.0, 50, 40),
    ("chrom06", "contig_inv_mid", 1, 15, 1, 15, 100.0, 80, 55),
    ("chrom06", "contig_inv_mid", 16, 35, 35, 16, 100.0, 80, 55),
    ("chrom06", "contig_inv_mid", 36, 55, 36, 55, 100.0, 80, 55),
]

NOISY = [
    ("chrom03", "small_inv", 1, 80, 1, 80, 99.0, 300, 180),
    ("chrom03", "small_inv", 81, 100, 100, 81, 98.5, 300, 180),
    ("chrom03", "small_inv", 101, 180, 101, 180, 99.1, 300, 180),
    ("chrom02", "chimera", 1, 120, 1, 120, 99.4, 300, 240),
    ("chrom07", "chimera", 1, 120, 121, 240, 99.2, 300, 240),
    ("chrom06", "inv_mid", 1, 60, 1, 60, 99.0, 300, 240),
    ("chrom06", "inv_mid", 61, 180, 180, 61, 99.3, 300, 240),
    ("chrom06", "inv_mid", 181, 240, 181, 240, 99.0, 300, 240),
    ("chrom10", "indels", 1, 60, 1, 60, 99.1, 300, 250),
    ("chrom10", "indels", 81, 130, 71, 120, 98.7, 300, 250),
    ("chrom11", "indels", 1, 130, 121, 250, 99.2, 300, 250),
]
NOISY_LENGTHS = {"small_inv": 180, "chimera": 240, "inv_mid": 240, "indels": 250, "alone": 20}
