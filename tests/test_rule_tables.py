"""Rule tables against the same rules in plain Python, on rows with several defects at once and with values at the bounds."""

import math
import random

from bandloom.operators import contracts as T


def finite(x):
    return x is not None and math.isfinite(x)


def text(x, most):
    return x is not None and x.strip(" ") != "" and len(x) <= most


def one_of(rng, usual, *others):
    return rng.choice(others) if rng.random() < 0.12 else usual


def claim_issues(kind, claims):
    if kind not in T.DOCUMENT_KINDS:
        return "refused", ["document_kind"]
    if claims is None or not 1 <= len(claims) <= 128:
        return "refused", ["claims"]
    out = []
    for i, (what, value, basis, reason, evidence) in enumerate(claims):
        say = lambda x: out.append(f"claims[{i}].{x}")  # noqa: B023, E731
        if what not in T.CLAIM_KINDS or basis not in T.BASES:
            say("kind_or_basis")
            continue
        if basis == "not_reported":
            if value is not None:
                say("not_reported_value")
            continue
        if basis == "inferred" and not (reason or "").strip(" "):
            say("inference_reason")
        if evidence is None or not 1 <= len(evidence) <= 16:
            say("evidence")
            continue
        for document, page, excerpt, origin in evidence:
            if not (document is not None and 1 <= len(document) <= 512 and page is not None and page >= 1 and excerpt is not None and 1 <= len(excerpt) <= 2000 and origin in T.ORIGINS):
                say("source")
            if what == "cited_synthesis" and origin is not None and origin != "cited_work":
                say("cited_origin")
        if what == "experimental_synthesis" and basis == "reported" and kind == "computational":
            say("computational_paper_is_not_an_experimental_sop")
    return ("needs_more_evidence" if out else "evidence_contract_valid_unverified"), out


def test_claims_with_several_defects(spark):
    rng, rows = random.Random(1), []
    for n in range(500):
        claims = []
        for _ in range(rng.choice([1, 2, 3, one_of(rng, 2, 0, 128, 129)])):
            evidence = [(one_of(rng, "paper", "", "d" * 512, "d" * 513, None), one_of(rng, 1, 0, -1, None), one_of(rng, "as written", "", "e" * 2000, "e" * 2001, None), one_of(rng, "cited_work", "current_paper", "author_data", "rumour", None)) for _ in range(one_of(rng, 1, 0, 2, 16, 17))]
            claims.append((rng.choice([*T.CLAIM_KINDS, one_of(rng, "property", "odd", None)]), one_of(rng, "3 eV", None), one_of(rng, "reported", "inferred", "not_reported", "odd", None), one_of(rng, None, "so", " "), one_of(rng, evidence, None)))
        rows.append((n, one_of(rng, rng.choice(T.DOCUMENT_KINDS), "blog", None), one_of(rng, claims, None)))
    kinds = "id int, document_kind string, claims array<struct<kind:string,value:string,basis:string,reason:string,evidence:array<struct<document_id:string,page_number:int,excerpt:string,origin:string>>>>"
    got = {r["id"]: (r["status"], r["issues"]) for r in T.claim_review(spark.createDataFrame(rows, kinds)).select("id", "status", "issues").collect()}
    assert got == {n: claim_issues(kind, claims) for n, kind, claims in rows}
    assert max(len(issues) for _, issues in got.values()) > 3


def observation_issues(o):
    bad, k, s, ref, src, bands, path = [], o["k_distance"], o["segment_ids"], o["energy_reference"], o["source"], o["bands"], o["path_segments"]
    check = lambda broken, name: bad.append(name) if broken else None
    check(o["schema_version"] != 2, "schema_version")
    if src is not None:
        document, page, panel, digest = src
        check(not text(document, 512), "source.document_id")
        check(not text(panel, 128), "source.panel_label")
        check(page is None or not 1 <= page <= 100_000, "source.page_number")
        check(digest is not None and not (len(digest) == 64 and set(digest) <= set("0123456789abcdef")), "source.source_sha256")
    check(o["energy_unit"] != "eV", "energy_unit")
    fermi = o["fermi_eV"]
    if ref is not None:
        kind, value, observed, evidence = ref
        check(kind not in ("fermi", "vbm", "arbitrary"), "energy_reference.kind")
        check(not finite(value), "energy_reference.value_eV")
        check(observed is None, "energy_reference.observed")
        check(not text(evidence, 1000), "energy_reference.evidence")
        check(kind == "fermi" and finite(fermi) and fermi != value, "fermi_eV.reference_mismatch")
        check(kind != "fermi" and fermi is not None, "fermi_eV.requires_fermi_reference")
    check(o["k_unit"] not in ("relative", "angstrom^-1"), "k_unit")
    whole = k is not None and 2 <= len(k) <= 8192 and all(map(finite, k))
    check(not whole, "k_distance")
    check(whole and max(k) <= min(k), "k_distance.range")
    matched = whole and s is not None and len(s) == len(k) and all(x is not None and x >= 0 for x in s)
    check(not matched, "segment_ids")
    if matched:
        runs = 1 + sum(a != b for a, b in zip(s, s[1:], strict=False))
        check(runs > len(set(s)), "segment_ids.reentered")
        check(any(s[i] == s[i - 1] and not k[i] > k[i - 1] for i in range(1, len(k))), "k_distance.nonmonotonic")
    if path is not None:
        check(not all(text(a, 128) and text(b, 128) for _, a, b in path), "path_segments.labels")
        check(matched and [p[0] for p in path] != [*dict.fromkeys(s or [])], "path_segments.coverage_or_order")
    check(not 1 <= len(bands) <= 4096, "bands")
    check(len({b[0] for b in bands}) < len(bands), "bands.band_id")
    check(not all(b[1] in ("valence", "conduction", "unknown") for b in bands), "bands.role")
    check(whole and not all(len(b[2]) == len(k) for b in bands), "bands.energies")
    energies = [x for b in bands for x in b[2]]
    check(any(x is not None and not math.isfinite(x) for x in energies), "bands.energies.not_finite")
    lacks = [("source", src is None), ("energy_reference", ref is None), ("energy_reference.observed", ref is not None and ref[2] is False), ("fermi_eV", ref is not None and ref[0] == "fermi" and not finite(fermi))]
    lacks += [("calibration_evidence", not text(o["calibration_evidence"], 1 << 30)), ("bands.energies", any(x is None for x in energies)), ("bands.role", any(b[1] == "unknown" for b in bands))]
    return bad, [name for name, x in lacks if x]


def test_observations_with_several_defects(spark):
    rng, rows, nan, inf = random.Random(2), [], float("nan"), float("inf")
    for n in range(400):
        odd = lambda usual, *others: one_of(rng, usual, *others)
        size = odd(4, 1, 2)
        k = [odd(float(i), float(i - 1), nan, inf) for i in range(size)]
        s = sorted(rng.randrange(3) for _ in range(odd(size, size + 1))) if rng.random() < 0.85 else [rng.randrange(-1, 3) for _ in range(size)]
        path = [(i, odd("G", "", " ", "x" * 128, "x" * 129), odd("X", None)) for i in dict.fromkeys(s)]
        bands = [(odd(f"b{i}", "b0"), odd("valence", "conduction", "unknown", "odd"), [odd(1.5, None, nan, -inf) for _ in range(odd(size, 3))]) for i in range(odd(2, 0, 1))]
        o = {
            "schema_version": odd(2, 1, None), "source": odd((odd("paper", " ", "p" * 512, "p" * 513), odd(1, 0, 100_000, 100_001, None), odd("a", "", "q" * 128), odd("ab" * 32, "AB" * 32, "ab", None)), None), "energy_unit": odd("eV", "Ry", None),
            "energy_reference": odd((odd("fermi", "vbm", "arbitrary", "odd"), odd(0.5, nan, None), odd(True, False, None), odd("line", "", "z" * 1000, "z" * 1001)), None), "fermi_eV": odd(0.5, 0.25, nan, None), "k_unit": odd("relative", "angstrom^-1", "metre", None),
            "k_distance": odd(k, None), "segment_ids": odd(s, None), "bands": bands, "calibration_evidence": odd("ticks", " ", None), "path_segments": odd(path, path[::-1], None),
        }
        rows.append((n, o))
    kinds = "id int, schema_version int, source struct<document_id:string,page_number:int,panel_label:string,source_sha256:string>, energy_unit string, energy_reference struct<kind:string,value_eV:double,observed:boolean,evidence:string>, fermi_eV double, k_unit string, k_distance array<double>, segment_ids array<int>, bands array<struct<band_id:string,role:string,energies:array<double>>>, calibration_evidence string, path_segments array<struct<segment_id:int,start_label:string,end_label:string>>"
    df = spark.createDataFrame([(n, *o.values()) for n, o in rows], kinds)
    got = {r["id"]: (r["invalid_fields"], r["missing_evidence"]) for r in T.observation_review(df).select("id", "invalid_fields", "missing_evidence").collect()}
    assert got == {n: observation_issues(o) for n, o in rows}
    assert sum(len(x[0]) > 1 for x in got.values()) > 100


def pair_problem(row, seen):
    key, valid, grp, inputs, segments, features, near, far, n = row
    if key is None or seen[key] > 1:
        return "identity"
    if valid is None:
        return "valid"
    if grp is None or grp <= 0:
        return "group"
    if not all(finite(x) for part in (inputs, features, far) for r in part for x in r):
        return "nonfinite"
    if not inputs or any(len(b) != 2 for b in inputs):
        return "band shape"
    if len(segments) != len(inputs):
        return "segments"
    if any(len(a) != 3 for a in features):
        return "atom features"
    if any(len(x) != len(features) or any(len(r) != 2 for r in x) for x in (near, far)):
        return "neighbour shape"
    if not 0 <= n <= len(features):
        return "atom count"
    if any(not -1 <= j < n for r in near for j in r) or any(d < 0 for r in far for d in r):
        return "neighbours"
    return "no usable graph" if valid and n < 1 else None


def test_pairs_with_several_defects(spark):
    rng, rows, nan = random.Random(3), [], float("nan")
    for i in range(500):
        odd = lambda usual, *others: one_of(rng, usual, *others)
        atoms, n = 3, odd(2, 0, 3, 4, -1)
        numbers = lambda size: [odd(1.0, nan) if rng.random() < 0.1 else 1.0 for _ in range(size)]
        rows.append((odd(i, i - 1, None), odd(True, False, None), odd(1, 0, None), [numbers(odd(2, 3) if rng.random() < 0.3 else 2) for _ in range(odd(2, 0))], [0] * odd(2, 1), [numbers(odd(3, 2) if rng.random() < 0.3 else 3) for _ in range(atoms)], [[odd(0, -1, 1, 2, -2) if rng.random() < 0.3 else 0 for _ in range(2)] for _ in range(odd(atoms, 2))], [[odd(1.0, 0.0, -0.5) if rng.random() < 0.3 else 1.0 for _ in range(2)] for _ in range(atoms)], n))
    seen = {}
    for r in rows:
        seen[r[0]] = seen.get(r[0], 0) + 1
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id int, valid boolean, grp int, band_input array<array<double>>, segment_ids array<int>, atom_features array<array<double>>, neighbor_list array<array<int>>, neighbor_dist array<array<double>>, n_atoms int, place int")
    got = {r["place"]: r["problem"] for r in T.pair_contract(df, "id", bands=2, features=3, neighbours=2).select("place", "problem").collect()}
    assert got == {i: pair_problem(r, seen) for i, r in enumerate(rows)}
    assert len(set(got.values())) >= 11
