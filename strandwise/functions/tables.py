"""Dimension tables: restriction enzymes, Cas nucleases, the genetic code and IUPAC codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Name, recognition sequence, cuts of the forward and the reverse strand from its start, category, cuts after the
# sequence of Type IIS enzymes (top, bottom), in common use, temperature of heat inactivation, other names. Facts of the enzymes.
_ENZYMES = """
EcoRI GAATTC 1 5 common_cloning - - yes 65 -
BamHI GGATCC 1 5 common_cloning - - yes none -
HindIII AAGCTT 1 5 common_cloning - - yes 80 -
PstI CTGCAG 5 1 common_cloning - - yes 80 -
EcoRV GATATC 3 3 common_cloning - - yes 80 -
SmaI CCCGGG 3 3 common_cloning - - yes 65 Cfr9I,XmaCI
XbaI TCTAGA 1 5 common_cloning - - yes 65 -
SpeI ACTAGT 1 5 common_cloning - - yes 80 BcuI
NheI GCTAGC 1 5 common_cloning - - yes 65 BmtI
KpnI GGTACC 5 1 common_cloning - - yes none -
Acc65I GGTACC 1 5 common_cloning - - yes 65 Asp718I
SacI GAGCTC 5 1 common_cloning - - yes 65 SstI
SalI GTCGAC 1 5 common_cloning - - yes 65 -
ClaI ATCGAT 2 4 common_cloning - - yes 65 BspDI,Bsu15I
XhoI CTCGAG 1 5 common_cloning - - yes 65 PaeR7I,SlaI
ApaI GGGCCC 5 1 common_cloning - - yes 65 -
NcoI CCATGG 1 5 common_cloning - - yes none Bsp19I
NdeI CATATG 2 4 common_cloning - - yes 65 -
BglII AGATCT 1 5 common_cloning - - yes none -
AgeI ACCGGT 1 5 common_cloning - - yes 65 BshTI,PinAI,AsiGI
MluI ACGCGT 1 5 common_cloning - - yes 80 BpiI
AvrII CCTAGG 1 5 common_cloning - - yes 80 BlnI,XmaJI
BsiWI CGTACG 1 5 common_cloning - - yes none Bspl407I
BspEI TCCGGA 1 5 common_cloning - - yes 80 AccIII,BseAI
Bsu36I CCTNAGG 2 5 common_cloning - - yes 80 Eco81I
DraI TTTAAA 3 3 common_cloning - - yes 65 AhaIII
EcoNI CCTNNNNNAGG 5 6 common_cloning - - no 65 BstENI
HpaI GTTAAC 3 3 common_cloning - - yes 65 KspAI
KasI GGCGCC 1 5 common_cloning - - yes 65 -
NarI GGCGCC 2 4 common_cloning - - yes 65 -
SfoI GGCGCC 3 3 common_cloning - - yes 65 -
NaeI GCCGGC 3 3 common_cloning - - no 65 CdoI,SauBM1I
NruI TCGCGA 3 3 common_cloning - - yes none Bsp68I,RruI
PpuMI RGGWCCY 2 5 common_cloning - - no none Psp5II
PshAI GACNNNNGTC 5 5 common_cloning - - no 65 BoxI
PspOMI GGGCCC 1 5 common_cloning - - yes 65 Bsp120I
PvuI CGATCG 4 2 common_cloning - - yes none BspCI,Ple19I
PvuII CAGCTG 3 3 common_cloning - - yes none -
SacII CCGCGG 4 2 common_cloning - - yes 65 Cfr42I,KspI,SstII
ScaI AGTACT 3 3 common_cloning - - yes 80 AssI
SnaBI TACGTA 3 3 common_cloning - - no 80 BstSNI,Eco105I
SphI GCATGC 5 1 common_cloning - - yes 65 PaeI
SrfI GCCCGGGC 4 4 common_cloning - - no none -
SspI AATATT 3 3 common_cloning - - yes 65 -
StuI AGGCCT 3 3 common_cloning - - yes none AatI,Eco147I
Tth111I GACNNNGTC 4 5 common_cloning - - no 65 AspI,PflFI
XmnI GAANNNNTTC 5 5 common_cloning - - yes 65 Asp700I,PdmI
ZraI GACGTC 3 3 common_cloning - - no 65 -
AatII GACGTC 5 1 common_cloning - - yes 80 -
NotI GCGGCCGC 2 6 rare_cutter - - yes 65 CspI
AscI GGCGCGCC 2 6 rare_cutter - - yes 80 PalAI,SgsI
FseI GGCCGGCC 6 2 rare_cutter - - yes 65 -
PacI TTAATTAA 5 3 rare_cutter - - yes 65 -
SbfI CCTGCAGG 6 2 rare_cutter - - yes 80 SdaI
SfiI GGCCNNNNNGGCC 8 5 rare_cutter - - yes none -
PmeI GTTTAAAC 4 4 rare_cutter - - yes 65 MssI
SwaI ATTTAAAT 4 4 rare_cutter - - yes 65 SmiI
AsiSI GCGATCGC 5 3 rare_cutter - - yes none RfaI,SfaAI
SgrAI CRCCGGYG 2 6 rare_cutter - - no 65 -
DpnI GATC 2 2 diagnostic_4cutter - - yes 80 -
HaeIII GGCC 2 2 diagnostic_4cutter - - yes 80 BsuRI,PalI
AluI AGCT 2 2 diagnostic_4cutter - - yes none -
RsaI GTAC 2 2 diagnostic_4cutter - - yes 65 AfaI
MspI CCGG 1 3 diagnostic_4cutter - - yes none HpaII
HhaI GCGC 3 1 diagnostic_4cutter - - yes 65 CfoI,Hin6I
TaqI TCGA 1 3 diagnostic_4cutter - - yes none TthHB8I
Sau3AI GATC 0 4 diagnostic_4cutter - - yes 65 Bsp143I,MboI,DpnII
MseI TTAA 1 3 diagnostic_4cutter - - yes 65 Tru9I,SaqAI
BfaI CTAG 1 3 diagnostic_4cutter - - no 80 MaeI
DdeI CTNAG 1 4 diagnostic_4cutter - - no 65 -
BsaI GGTCTC 7 11 type_iis 1 5 yes 65 Eco31I
BsmBI CGTCTC 7 11 type_iis 1 5 yes 80 Esp3I
Esp3I CGTCTC 7 11 type_iis 1 5 yes 80 BsmBI
BbsI GAAGAC 8 12 type_iis 2 6 yes 65 BpiI
PaqCI CACCTGC 11 15 type_iis 4 8 yes 65 AarI
AarI CACCTGC 11 15 type_iis 4 8 yes 65 PaqCI
SapI GCTCTTC 8 11 type_iis 1 4 yes 65 BspQI
BspQI GCTCTTC 8 11 type_iis 1 4 yes 65 SapI
BseRI GAGGAG 16 14 type_iis 10 8 no 65 -
BsgI GTGCAG 22 20 type_iis 16 14 no 65 -
BsmI GAATGC 7 5 type_iis 1 -1 no 65 Mva1269I
BtgZI GCGATG 16 20 type_iis 10 14 yes 65 -
FokI GGATG 14 18 type_iis 9 13 yes 65 -
EarI CTCTTC 7 10 type_iis 1 4 yes 65 Eam1104I,Ksp632I
HphI GGTGA 13 12 type_iis 8 7 no 65 -
MlyI GAGTC 10 10 type_iis 5 5 no 65 -
MmeI TCCRAC 26 24 type_iis 20 18 no 65 -
"""

# PAM, its side, length of the spacer, cuts of the top and bottom strand from the PAM, best GC range, other names.
_NUCLEASES = """
SpCas9 NGG 3prime 20 -3 -3 40 60 Cas9,pyogenes
SaCas9 NNGRRT 3prime 21 -3 -3 40 60 aureus
Cas12a TTTV 5prime 23 18 23 35 65 Cpf1,AsCas12a,LbCas12a
Cas12e TTCN 5prime 20 12 14 35 65 CasX
"""

#: Base sets of the IUPAC codes.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT",
    "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}

#: Amino acids of the 64 codons in the order of bases T, C, A, G; the standard code, and how tables 2 and 11 differ from it.
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODE_CHANGES = {1: {}, 2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"}, 11: {}}


def codons(table: int = 1) -> dict[str, str]:
    order = "TCAG"
    standard = {a + b + c: STANDARD_CODE[16 * i + 4 * j + k] for i, a in enumerate(order) for j, b in enumerate(order) for k, c in enumerate(order)}
    return standard | CODE_CHANGES[table]


def _rows(text: str) -> list[list[str]]:
    return [line.split() for line in text.split("\n") if line]


def enzymes(*names: str) -> list[dict]:
    """Enzymes in order; all, or those named (by name, any case)."""
    out = []
    for name, site, fwd, rev, category, top, bottom, common, heat, other in _rows(_ENZYMES):
        f, r = int(fwd), int(rev)
        out.append({
            "enzyme_id": name.lower(), "name": name, "aliases": [] if other == "-" else other.split(","), "recognition": site, "fwd_cut": f, "rev_cut": r,
            "enzyme_class": "type_iis" if category == "type_iis" else "type_ii", "category": category, "top_cut": None if top == "-" else int(top), "bottom_cut": None if bottom == "-" else int(bottom),
            "overhang_len": abs(f - r), "polarity": "5prime" if f < r else "3prime" if f > r else "blunt", "is_common": common == "yes", "heat_inactivation": None if heat == "none" else int(heat),
        })
    wanted = {n.lower() for n in names}
    return [e for e in out if not wanted or e["enzyme_id"] in wanted]


ENZYME_SCHEMA = "enzyme_id string, name string, aliases array<string>, recognition string, fwd_cut int, rev_cut int, enzyme_class string, category string, top_cut int, bottom_cut int, overhang_len int, polarity string, is_common boolean, heat_inactivation int"


def enzyme_table(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame(enzymes(*names), ENZYME_SCHEMA)


def nuclease(name: str) -> dict:
    """A nuclease by name or other name, in any case; SpCas9 for names not known."""
    rows = [dict(zip(("name", "pam", "side", "spacer", "top", "bottom", "gc_low", "gc_high", "other"), r, strict=True)) for r in _rows(_NUCLEASES)]
    key = name.strip().lower()
    found = next((r for r in rows if key in [r["name"].lower(), *r["other"].lower().split(",")]), rows[0])
    return found | {k: int(found[k]) for k in ("spacer", "top", "bottom", "gc_low", "gc_high")}
