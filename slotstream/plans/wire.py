"""Queries over bytes: headers, payload slices, chunks, Merkle folds, entry streams and recovery."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from slotstream.functions import codec, wire
from slotstream.operators import entries, pipeline, recovery, verify
from slotstream.plans.registry import query


@query("""WITH c AS (SELECT doc_id, i AS chunk, substr(text, i * 64 + 1, 64) AS body FROM documents, unnest(range(0, greatest(1, CAST(ceil(length(text) / 64.0) AS BIGINT)))) AS t(i))
SELECT doc_id, count(*) AS chunks, md5(string_agg(body, '' ORDER BY chunk)) AS digest FROM c GROUP BY doc_id""")
def chunk_roundtrip(documents):
    """Texts cut into 64-character chunks in one scan, and put together again; no text leaves its row."""
    chunks = F.regexp_extract_all("text", F.lit("(?s).{1,64}"), F.lit(0))
    return documents.select("doc_id", chunks.alias("c")).select("doc_id", F.greatest(F.lit(1), F.size("c")).cast("bigint").alias("chunks"), F.md5(F.array_join("c", "")).alias("digest"))


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, CASE WHEN doc_id = 0 THEN 0 ELSE length(bin(doc_id)) END - CASE WHEN doc_id % 5 = 4 THEN 1 ELSE 0 END AS n, sha256(unhex(concat('{verify.LEAF.hex()}', hex(encode(text))))) AS h FROM documents WHERE text IS NOT NULL),
f(doc_id, n, k, i, h) AS (SELECT doc_id, n, 0, doc_id, h FROM l UNION ALL
  SELECT doc_id, n, k + 1, i // 2, sha256(unhex(concat('{verify.NODE.hex()}', CASE WHEN i % 2 = 0 THEN concat(substr(h, 1, 40), substr(sha256(concat('proof', k, '-', doc_id)), 1, 40)) ELSE concat(substr(sha256(concat('proof', k, '-', doc_id)), 1, 40), substr(h, 1, 40)) END))) FROM f WHERE k < n)
SELECT d.doc_id, CASE WHEN i = 0 THEN h END AS root FROM documents AS d LEFT JOIN f ON f.doc_id = d.doc_id AND f.k = f.n""")
def merkle_fold(documents):
    """Merkle root of the whole text as leaf and a proof of 20-byte nodes: left or right by the bits of the
    index (the id); every fifth proof is a step short, and an index that doesn't end at 0 has no root."""
    index = F.col("doc_id")
    size = F.when(index == 0, 0).otherwise(F.length(F.bin(index))) - F.when(index % 5 == 4, 1).otherwise(0)
    steps = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    proof = F.transform(steps, lambda k: F.substring(F.sha2(F.concat(F.lit("proof"), k.cast("string"), F.lit("-"), index.cast("string")), 256), 1, 40))
    root = verify.root_column(F.encode("text", "UTF-8"), index, proof)
    return documents.select("doc_id", root.alias("root"))


@query("SELECT doc_id FROM documents WHERE octet_length(encode(text)) BETWEEN 100 AND 3000 AND substr(text, 3, 2) IN ('e ', 'er', 'nt') AND md5(text) = md5(decode(from_base64(to_base64(encode(text)))))")
def memcmp_filter(documents):
    """Account filters: data size, bytes at an offset, and a base64 payload that decodes under its cap."""
    body = F.decode(F.unbase64(F.base64(F.encode("text", "UTF-8"))), "UTF-8")
    return documents.where(F.octet_length("text").between(100, 3000) & F.substring("text", 3, 2).isin("e ", "er", "nt") & (F.md5("text") == F.md5(body))).select("doc_id")


@query("""SELECT doc_id, i AS ordinal, md5(substr(text, CAST(i * 40 + 1 AS BIGINT), 40)) AS slice, CASE WHEN length(text) >= 65 THEN md5(substr(text, 2, 64)) END AS first_signature
FROM documents, unnest(range(0, CAST(ceil(length(text) / 40.0) AS BIGINT))) AS t(i)""")
def payload_slices(documents):
    """All slices of 40 characters of each payload, the short last one too, and its first signature."""
    first = F.when(F.length("text") >= 65, F.md5(F.substring("text", 2, 64)))
    rows = documents.select("doc_id", first.alias("first_signature"), F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,40}"), F.lit(0))).alias("ordinal", "body"))
    return rows.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.md5("body").alias("slice"), "first_signature")


def packets(v_shred):
    """Synthetic wire packets of fragments: returned parts are code packets, the others data."""
    code = F.col("sig") == "R"
    zeros = lambda n: F.unhex(F.lit("00" * n))
    flags = F.when(F.col("last_in_slot"), 0xC0).when(F.col("data_complete"), 0x40).otherwise(0) + F.col("idx") % 64
    head = [zeros(64), wire.le_bytes(F.when(code, 0x62).otherwise(0x92), 1), wire.le_bytes(F.col("slot"), 8), wire.le_bytes(F.col("idx"), 4), wire.le_bytes(F.col("source") % 65536, 2), wire.le_bytes(F.col("fec_set"), 4)]
    data = F.concat(*head, wire.le_bytes(F.least(F.col("slot") % 5, F.col("slot")), 2), wire.le_bytes(flags, 1), wire.le_bytes(88 + F.col("payload_len"), 2), zeros(wire.DATA_PACKET - 88))
    coded = F.concat(*head, wire.le_bytes(F.lit(4), 2), wire.le_bytes(F.lit(2), 2), wire.le_bytes(F.col("idx") % 3, 2), zeros(wire.CODE_PACKET - 89))
    return v_shred.select("slot", "idx", "arrival", F.when(code, coded).otherwise(data).alias("packet"))


@query("""SELECT CASE WHEN sig <> 'R' THEN 'Data' WHEN idx % 3 < 2 THEN 'Code' END AS type, CASE WHEN sig = 'R' AND idx % 3 = 2 THEN 'bad_coding' END AS error, count(*) AS n, count(*) FILTER (sig <> 'R' OR idx % 3 < 2) AS same,
count(*) FILTER (sig <> 'R' AND last_in_slot) AS last, count(*) FILTER (sig <> 'R' AND data_complete) AS complete FROM v_shred GROUP BY ALL""")
def shred_wire_roundtrip(v_shred):
    """Headers parsed from packet bytes: agreement with the rows they were made of, and errors."""
    parsed = packets(v_shred).select(F.col("slot").alias("s"), F.col("idx").alias("i"), *[c.alias(n) for n, c in wire.header(F.col("packet")).items()])
    same = (F.col("s") == F.col("slot")) & (F.col("i") == F.col("idx"))
    return parsed.groupBy("type", "error").agg(F.count("*").alias("n"), F.count_if(same).alias("same"), F.count_if("last_in_slot").alias("last"), F.count_if("data_complete").alias("complete"))


def synthetic_payload(slot: int, n: int) -> bytes:
    """An entry stream of one entry with ``n`` small transactions."""
    body = bytearray((1).to_bytes(8, "little") + bytes(40) + n.to_bytes(8, "little"))
    for k in range(n):
        body += codec.compact_bytes(1) + slot.to_bytes(32, "little") + k.to_bytes(32, "little") + bytes([1, 0, 1])
        body += codec.compact_bytes(2) + bytes(96) + codec.compact_bytes(1) + bytes([1]) + codec.compact_bytes(1) + bytes([0]) + codec.compact_bytes(k % 5) + bytes(k % 5)
    return bytes(body)


@query("""WITH n AS (SELECT slot, count(*) AS n FROM v_tx GROUP BY slot)
SELECT slot, n AS transactions, CAST(56 + 170 * n + 10 * (n // 5) + (n % 5) * (n % 5 - 1) // 2 AS BIGINT) AS bytes, CAST(CASE WHEN slot % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS skipped FROM n""")
def entry_stream_decode(v_tx):
    """Transactions found by structure in synthetic payloads cut into fragments, a torn one in front of every third."""
    def build(batches):
        for pdf in batches:
            parts = []
            for slot, n in zip(pdf.slot, pdf.n, strict=True):
                payload = synthetic_payload(int(slot), int(n))
                parts.append(([b"\xff" * 10] if slot % 3 == 0 else []) + [payload[i : i + 100] for i in range(0, len(payload), 100)])
            yield pd.DataFrame({"slot": pdf.slot, "fragments": parts})

    made = v_tx.groupBy("slot").agg(F.count("*").alias("n")).mapInPandas(build, "slot bigint, fragments array<binary>")
    return entries.transaction_ranges(made).groupBy("slot").agg(F.count("*").alias("transactions"), F.max("end").alias("bytes"), F.max("skipped").alias("skipped"))


@query("SELECT DISTINCT slot, fec_set, CAST(CASE WHEN (slot + fec_set) % 4 = (slot * 3 + 1) % 4 THEN 1 ELSE 2 END AS BIGINT) AS recovered, true AS exact FROM v_shred")
def rs_recover(v_shred):
    """Erasure sets of four data and two code shards with two shards lost: all data comes back."""
    def build(batches):
        for pdf in batches:
            rows = []
            for slot, fec in zip(pdf.slot, pdf.fec_set, strict=True):
                data = [f"{slot}:{fec}:{k}".encode().ljust(24, b".") for k in range(4)]
                lost = {int(slot + fec) % 4, int(slot * 3 + 1) % 4}
                rows += [(slot, fec, p, 4, 2, p, b) for p, b in enumerate(data + recovery.encode(data, 2)) if p not in lost]
            yield pd.DataFrame(rows, columns=["slot", "fec_set", "place", "n_data", "n_code", "arrival", "payload"])

    sets = v_shred.select("slot", "fec_set").distinct()
    made = sets.mapInPandas(build, "slot bigint, fec_set bigint, place bigint, n_data bigint, n_code bigint, arrival bigint, payload binary")
    found = recovery.recovered(made)
    want = F.rpad(F.concat_ws(":", F.col("slot").cast("string"), F.col("fec_set").cast("string"), F.col("place").cast("string")), 24, ".")
    return found.groupBy("slot", "fec_set").agg(F.count("*").alias("recovered"), F.bool_and(F.col("payload").cast("string") == want).alias("exact"))


def signed_packets(v_peer):
    """(pubkey, arrival, ms, packet): one packet of each peer's slot, signed by it; by ``pubkey % 8`` with a fault.

    1: cut short; 2: the index lies beyond its proof; 3: signed by another; 4, 5: a slot without a
    leader; 6: as 0, twice; 7: an unknown variant.
    """
    def build(batches):
        for pdf in batches:
            rows = []
            for key in pdf.pubkey.astype(int):
                case, kind = key % 8, "Code" if key % 3 == 0 else "Data"
                body = verify.packet(kind, key, 9 if case == 2 else 3, 0, proof=[bytes([key % 256, k]) * 10 for k in range(2)])
                made = verify.signed(body, verify.seed(key + 1 if case == 3 else key))
                made = made[:500] if case == 1 else made[:64] + b"\x10" + made[65:] if case == 7 else made
                rows += [(key, 2 * key + n, 1000 + n, made) for n in range(2 if case == 6 else 1)]
            yield pd.DataFrame(rows, columns=["pubkey", "arrival", "ms", "packet"])

    return v_peer.select("pubkey").mapInPandas(build, "pubkey bigint, arrival bigint, ms bigint, packet binary")


@query("""SELECT pubkey, pubkey * 2 + n AS arrival, CASE pubkey % 8 WHEN 1 THEN 'Malformed' WHEN 7 THEN 'Malformed' WHEN 2 THEN 'InvalidMerkle' WHEN 3 THEN 'InvalidSignature' WHEN 4 THEN 'UnknownLeader' WHEN 5 THEN CASE WHEN pubkey = 5 THEN 'Verified' ELSE 'UnknownLeader' END ELSE 'Verified' END AS status
FROM v_peer, unnest(range(0, CASE WHEN pubkey % 8 = 6 THEN 2 ELSE 1 END)) AS t(n)""")
def verify_packets(v_peer):
    """Signed packets against the leaders of their slots; a slot without a leader tries the known keys (peer 5's)."""
    def keys(batches):
        for pdf in batches:
            yield pd.DataFrame({"slot": pdf.pubkey, "leader": [verify.public(verify.seed(int(k))) for k in pdf.pubkey]})

    leaders = v_peer.where("pubkey % 8 not in (4, 5)").select("pubkey").mapInPandas(keys, "slot bigint, leader binary")
    known = [verify.public(verify.seed(5))]
    return verify.verified(signed_packets(v_peer), leaders, known).select("pubkey", "arrival", "status")

def fec_packets(nation):
    """(set_id, arrival, ms, packet): signed erasure sets of four data and two code packets, one set a nation, two packets lost.

    The erasure code covers a data packet from behind its signature, and a code packet from behind
    its headers, up to the proof.
    """
    def build(batches):
        for pdf in batches:
            rows = []
            for key in pdf.n_nationkey.astype(int):
                proof = [bytes([key, k]) * 10 for k in range(3)]
                data = [bytearray(verify.packet("Data", key, k, 0, proof)) for k in range(4)]
                for k, body in enumerate(data):
                    body[wire.DATA_HEADER : wire.DATA_HEADER + 8] = f"n{key:03}i{k:03}".encode()
                end = wire.DATA_PACKET - 60
                parity = recovery.encode([bytes(b[64:end]) for b in data], 2)
                code = [bytearray(verify.packet("Code", key, k, 0, proof, position=k, n_data=4, n_code=2)) for k in range(2)]
                for body, shard in zip(code, parity, strict=True):
                    body[89 : wire.CODE_PACKET - 60] = shard
                lost = {key % 4, 4 + key % 2} if key % 3 else {key % 4, (key + 1) % 4}
                rows += [(key, n, 1000 + n, verify.signed(bytes(b), verify.seed(key))) for n, b in enumerate(data + code) if n not in lost]
            yield pd.DataFrame(rows, columns=["set_id", "arrival", "ms", "packet"])

    return nation.select("n_nationkey").mapInPandas(build, "set_id bigint, arrival bigint, ms bigint, packet binary")


@query("""SELECT n_nationkey AS slot, idx, idx = n_nationkey % 4 OR (n_nationkey % 3 = 0 AND idx = (n_nationkey + 1) % 4) AS recovered, concat('n', lpad(CAST(n_nationkey AS VARCHAR), 3, '0'), 'i', lpad(CAST(idx AS VARCHAR), 3, '0')) AS body
FROM nation, unnest(range(0, 4)) AS t(idx) WHERE n_nationkey % 7 <> 6""")
def packet_pipeline(nation):
    """Packets verified, erasure sets completed, and data given out: received and recovered (slots of no known leader are refused)."""
    def keys(batches):
        for pdf in batches:
            yield pd.DataFrame({"slot": pdf.n_nationkey.astype("int64"), "leader": [verify.public(verify.seed(int(k))) for k in pdf.n_nationkey]})

    leaders = nation.where("n_nationkey % 7 <> 6").select("n_nationkey").mapInPandas(keys, "slot bigint, leader binary")
    out = pipeline.processed(fec_packets(nation), leaders, strict=True)
    return out.select("slot", "idx", "recovered", F.decode(F.substring("data", wire.DATA_HEADER + 1 - 64, 8), "UTF-8").alias("body"))
