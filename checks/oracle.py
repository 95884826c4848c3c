"""DuckDB statements that state each query a second time, by other means.

The session facts are written here with self-joins and filtered aggregates, not with the
windows the engine uses.
"""

from __future__ import annotations

from checks.forest_sql import forest
from checks.views import AS_OF_EPOCH, CERTIFICATES_SQL, PACE, PACKETS_SQL, START_US, STREAMS_SQL
from sealcheck.tables import (
    ALL_INSIDE, BASELINE_ADVICE, CAPABILITY_WORDS, CIPHER_SUITES, CLEARTEXT_FORBIDDEN, CLEARTEXT_MODES, EVIDENCE, FALLBACK_NOTE, FEATURES,
    IMPLICIT_FORBIDDEN, MAIL_VOCABULARY, PAYLOAD_TOKENS, PROFILES, REJECTED_MODES, RULES, SERVER_GREETINGS,
    SEVERITIES, SWEEP_PORTS, TLS_VERSIONS, UPGRADE_FORBIDDEN, UPGRADE_MODES,
)


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(q(v) for v in value) + "]::VARCHAR[]"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def one_of(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def port_protocol(port: str) -> str:
    return f"CASE WHEN {port} IN (25,465,587) THEN 'SMTP' WHEN {port} IN (143,993) THEN 'IMAP' WHEN {port} IN (110,995) THEN 'POP3' END"


PACKETS = "packets AS (SELECT *, {0} + CAST(FLOOR((epoch_us(ts) - {0}) / CAST({1} AS DOUBLE)) AS BIGINT) AS ts_us FROM ({2}) base0)".format(
    START_US, PACE, PACKETS_SQL.format(events="events"))
CERT_ROWS = f"(SELECT stream_id, unnest([0, 1]) AS pos FROM ({STREAMS_SQL.format(events='events')}) s) r"
CERTS = f"certs AS (SELECT *, sha256(repeat(cert_text, 8)) AS digest FROM ({CERTIFICATES_SQL.format(certs=CERT_ROWS)}) c0)"
SUITES = "suites(code, name, kx, strength) AS (VALUES " + ", ".join(
    f"({q(c)}, {q(n)}, {q(k)}, {s})" for c, (n, k, s) in CIPHER_SUITES.items()) + ")"
STANDARD = "(25,465,587,143,993,110,995)"


def capability(line: str) -> str:
    return "(" + " OR ".join(f"contains(upper({line}), {q(w)})" for w in CAPABILITY_WORDS) + ")"


def verdict(line: str, tag: str | None = None) -> str:
    text = f"regexp_replace({line}, '^\\s+|\\s+$', '', 'g')"
    if tag:
        head = f"lower(regexp_extract({text}, '^(\\S+) +', 1))"
        body = (f"CASE WHEN {head} = {tag} AND regexp_matches({text}, '(?i)^\\S+ +OK\\b') THEN 'positive' "
                f"WHEN {head} = {tag} AND regexp_matches({text}, '(?i)^\\S+ +(NO|BAD|BYE)\\b') THEN 'negative' END")
    else:
        code = f"TRY_CAST(regexp_extract({text}, '^(\\d{{3}})[ -]', 1) AS INT)"
        body = (f"CASE WHEN regexp_matches({text}, '(?i)^\\+OK\\b') THEN 'positive' "
                f"WHEN regexp_matches({text}, '(?i)^-ERR\\b') THEN 'negative' "
                f"WHEN {code} BETWEEN 200 AND 299 THEN 'positive' WHEN {code} >= 400 THEN 'negative' "
                f"WHEN {code} IS NOT NULL THEN NULL "
                f"WHEN regexp_matches({text}, '(?i)^\\S{{1,16}} +OK\\b') THEN 'positive' "
                f"WHEN regexp_matches({text}, '(?i)^\\S{{1,16}} +(NO|BAD|BYE)\\b') THEN 'negative' END")
    return f"CASE WHEN {capability(text)} THEN NULL ELSE {body} END"


def clear_auth(text: str, protocol: str) -> str:
    flat = f"regexp_replace({text}, '\\s+', ' ', 'g')"
    pattern = {"SMTP": r"\bAUTH(ENTICATE)? +(PLAIN|LOGIN|NTLM)\b", "IMAP": r"\bLOGIN +\S+|\bAUTHENTICATE +(PLAIN|LOGIN)\b",
               "POP3": r"\b(USER|PASS) +\S+"}[protocol]
    return f"regexp_matches({flat}, '(?i){pattern}')"


def rank(version: str) -> str:
    return "CASE " + version + " " + " ".join(f"WHEN {q(v)} THEN {i}" for i, v in enumerate(TLS_VERSIONS, 1)) + " ELSE 0 END"


def display(value: str, alias: str) -> str:
    return f"CASE WHEN {alias}.name IS NOT NULL THEN {alias}.name || ' (' || {alias}.code || ')' ELSE {value} END"


def signalling(code: str) -> str:
    return f"({code} IN ('0x00ff', '0x5600') OR (substr({code}, 3, 2) = substr({code}, 5, 2) AND substr({code}, 4, 1) = 'a'))"


SESSIONS = f"""
pk AS (SELECT *, {port_protocol('src_port')} AS src_proto, {port_protocol('dst_port')} AS dst_proto FROM packets),
head AS (SELECT capture, stream_id, src_ip AS src_ip0, dst_ip AS dst_ip0, src_port AS src0, dst_port AS dst0,
    src_proto AS sp0, dst_proto AS dp0, coalesce(src_proto, dst_proto) AS port_proto FROM pk WHERE idx = 1),
hints AS (SELECT stream_id, arg_min(CASE WHEN dst_proto IS NOT NULL THEN dst_port ELSE src_port END, idx) AS hint
    FROM pk WHERE dst_proto IS NOT NULL OR src_proto IS NOT NULL GROUP BY stream_id),
dir AS (SELECT pk.*, head.port_proto, CASE WHEN src_port = hint THEN FALSE WHEN dst_port = hint THEN TRUE ELSE src_port = src0 END AS from_client
    FROM pk JOIN head USING (capture, stream_id) LEFT JOIN hints USING (stream_id)),
cmd AS (SELECT stream_id, idx, CASE WHEN port_proto = 'IMAP' THEN lower(nullif(regexp_extract(mail_text, '(?i)^([A-Za-z0-9*+._-]{{1,16}}) +(STARTTLS|STLS)\\b', 1), '')) END AS tag
    FROM dir WHERE from_client AND regexp_matches(mail_text, '(?i)(^|[^A-Za-z])(STARTTLS|STLS)\\b')),
reply AS (SELECT d.stream_id, c.idx AS cmd_idx, d.idx, CASE WHEN c.tag IS NULL THEN {verdict('d.mail_text')} ELSE {verdict('d.mail_text', 'c.tag')} END AS v
    FROM dir d JOIN cmd c ON c.stream_id = d.stream_id AND d.idx > c.idx AND d.idx - c.idx <= 4
    WHERE NOT d.from_client AND d.mail_text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cmd x WHERE x.stream_id = d.stream_id AND x.idx > c.idx AND x.idx < d.idx)),
answers AS (SELECT stream_id, bool_or(v = 'positive') AS yes, bool_or(v = 'negative') AS no FROM (
    SELECT stream_id, cmd_idx, arg_min(v, idx) AS v FROM reply WHERE v IS NOT NULL GROUP BY stream_id, cmd_idx) a GROUP BY stream_id),
gaps AS (SELECT a.stream_id, CAST(sum(CASE WHEN b.ts_us - a.ts_us BETWEEN 0 AND 300000000 THEN b.ts_us - a.ts_us ELSE 0 END) AS BIGINT) AS stepped
    FROM pk a JOIN pk b ON a.stream_id = b.stream_id AND b.idx = a.idx + 1 GROUP BY a.stream_id),
offer AS (SELECT stream_id, string_agg({display('value', 's')}, ';' ORDER BY pos) AS offered, count(*) AS n FROM (
    SELECT stream_id, pos, value, row_number() OVER (PARTITION BY stream_id ORDER BY pos) AS rn FROM (
      SELECT stream_id, unnest(string_split(suites, ',')) AS value, generate_subscripts(string_split(suites, ','), 1) AS pos FROM pk WHERE hs_type = 1) u
    WHERE NOT {signalling('value')}) o LEFT JOIN suites s ON s.code = o.value WHERE rn <= 8 GROUP BY stream_id),
agg AS (SELECT capture, stream_id, count(*) AS packet_count, CAST(sum(frame_len) AS BIGINT) AS byte_count,
    count(*) FILTER (retransmission) AS retransmission_count, min(frame) AS first_frame, max(frame) AS last_frame,
    min(ts_us) AS start_us, max(ts_us) AS end_us, count(mail_text) AS n_text, max(spoken) AS spoken,
    min(idx) FILTER (is_tls) AS t_idx, bool_or(coalesce(hs_type = 1, FALSE)) AS ch, bool_or(coalesce(hs_type = 2, FALSE)) AS sh,
    count(*) FILTER (hs_type = 1) AS n_ch, bool_or(n_certs > 0) AS cert_seen, bool_or(alert) AS alert_seen, count(*) FILTER (failure) AS failures,
    max(sni) AS sni, max(key_group) AS named_group, max(server_cipher) AS server_cipher,
    max({rank('server_version')}) FILTER (hs_type = 2) AS sv_rank, max(n_certs) AS n_certs, max(leaf_text) AS leaf_text,
    bool_or(coalesce(supported IS NOT NULL AND hs_type = 1, FALSE)) AS offers13
    FROM pk GROUP BY capture, stream_id),
text AS (SELECT stream_id, coalesce(bool_or(NOT from_client AND regexp_matches(mail_text, '(?i)\\b(STARTTLS|STLS)\\b')), FALSE) AS advertised,
    min(idx) FILTER (from_client AND CASE port_proto WHEN 'SMTP' THEN {clear_auth('mail_text', 'SMTP')} WHEN 'IMAP' THEN {clear_auth('mail_text', 'IMAP')}
      WHEN 'POP3' THEN {clear_auth('mail_text', 'POP3')} ELSE FALSE END) AS auth_idx FROM dir GROUP BY stream_id),
first_cmd AS (SELECT stream_id, min(idx) AS cmd_idx FROM cmd GROUP BY stream_id),
s0 AS (SELECT agg.*, head.* EXCLUDE (capture, stream_id), 'tcp.stream.' || agg.stream_id AS session_id,
    CASE WHEN dp0 IS NULL AND sp0 IS NOT NULL THEN dst_ip0 ELSE src_ip0 END AS client_ip,
    CASE WHEN dp0 IS NULL AND sp0 IS NOT NULL THEN dst0 ELSE src0 END AS client_port,
    CASE WHEN dp0 IS NULL AND sp0 IS NOT NULL THEN src_ip0 ELSE dst_ip0 END AS server_ip,
    CASE WHEN dp0 IS NULL AND sp0 IS NOT NULL THEN src0 ELSE dst0 END AS server_port,
    CASE WHEN port_proto IS NOT NULL THEN port_proto WHEN n_text > 0 THEN spoken ELSE 'UNKNOWN' END AS protocol,
    CASE WHEN port_proto IS NOT NULL OR n_text > 0 THEN 0.98 ELSE 0.0 END AS protocol_confidence,
    CASE WHEN end_us - start_us <= 21600000000 THEN (end_us - start_us) / 1e6 * 1000 ELSE coalesce(stepped, 0) / 1e6 * 1000 END AS duration_ms,
    advertised AS starttls_advertised, cmd_idx IS NOT NULL AS starttls_command, coalesce(yes, FALSE) AS answered_yes, coalesce(no, FALSE) AS answered_no,
    coalesce(cmd_idx <= t_idx, FALSE) AS reached, auth_idx IS NOT NULL AND (t_idx IS NULL OR auth_idx < t_idx) AS plaintext_auth,
    offered, coalesce(n, 0) AS n_offered
    FROM agg JOIN head USING (capture, stream_id) LEFT JOIN gaps USING (stream_id) JOIN text USING (stream_id) LEFT JOIN first_cmd USING (stream_id)
    LEFT JOIN answers USING (stream_id) LEFT JOIN offer USING (stream_id)),
s1 AS (SELECT s0.*, server_port IN (465, 993, 995) AS implicit_tls, t_idx IS NOT NULL OR server_port IN (465, 993, 995) AS tls_detected,
    reached OR server_port IN (465, 993, 995) AS upgrade_successful,
    CASE WHEN answered_yes OR reached THEN TRUE WHEN answered_no THEN FALSE END AS starttls_accepted,
    NOT answered_yes AND answered_no AND NOT reached AS starttls_rejected,
    CASE sv_rank WHEN 1 THEN 'SSLv3' WHEN 2 THEN 'TLS 1.0' WHEN 3 THEN 'TLS 1.1' WHEN 4 THEN 'TLS 1.2' WHEN 5 THEN 'TLS 1.3' END AS tls_version,
    CASE WHEN sv_rank > 0 THEN 'SERVER_HELLO' ELSE 'UNKNOWN' END AS version_source,
    CASE WHEN NOT ch THEN '' WHEN offers13 THEN 'TLS 1.2;TLS 1.3' ELSE 'TLS 1.2' END AS offered_versions,
    {display('server_cipher', 'su')} AS cipher_suite,
    CASE WHEN server_cipher IS NOT NULL THEN 'SERVER_HELLO' WHEN n_offered > 0 THEN 'CLIENT_OFFER' ELSE 'UNKNOWN' END AS cipher_source,
    su.kx AS key_exchange, CASE WHEN su.kx IN ('NULL', 'ANON', 'PSK') THEN NULL ELSE su.kx <> 'RSA' END AS forward_secrecy,
    coalesce(su.strength, 0) AS cipher_strength, su.name IS NOT NULL AS cipher_known,
    ch AND sh AS handshake_complete, greatest(n_ch - 1, 0) AS repeated,
    concat_ws(';', CASE WHEN starttls_advertised THEN {q(EVIDENCE['advertised'])} END, CASE WHEN starttls_command THEN {q(EVIDENCE['command'])} END,
      CASE WHEN answered_yes THEN {q(EVIDENCE['accepted'])} END,
      CASE WHEN answered_no AND NOT answered_yes AND NOT reached THEN {q(EVIDENCE['rejected'])} WHEN answered_no THEN {q(EVIDENCE['refused_first'])} END,
      CASE WHEN reached THEN {q(EVIDENCE['upgraded'])} END, CASE WHEN server_port IN (465, 993, 995) THEN {q(EVIDENCE['implicit'])} END,
      CASE WHEN plaintext_auth THEN {q(EVIDENCE['clear_auth'])} END) AS evidence
    FROM s0 LEFT JOIN suites su ON su.code = server_cipher),
leaf AS (SELECT stream_id, subject, issuer, substr(subject, 4) AS common_name, san, key_algorithm, key_bits, sig_hash, valid_from_epoch, valid_until_epoch,
    {AS_OF_EPOCH} > valid_until_epoch AS expired, {AS_OF_EPOCH} < valid_from_epoch AS early,
    CAST(floor((valid_until_epoch - {AS_OF_EPOCH}) / 86400.0) AS INT) AS days_remaining, subject = issuer AS self_signed,
    sig_hash IN ('md5', 'sha1') AS weak_signature, (key_algorithm = 'RSA' AND key_bits < 2048) OR (key_algorithm = 'EC' AND key_bits < 256) AS weak_key
    FROM certs WHERE pos = 0),
links AS (SELECT a.stream_id, a.issuer = b.subject AS linked, b.subject = b.issuer AS rooted FROM certs a JOIN certs b ON a.stream_id = b.stream_id AND a.pos = 0 AND b.pos = 1),
s2 AS (SELECT s1.*, n_certs > 0 AS cert_present, n_certs > 0 AND NOT starts_with(leaf_text, '0bad') AS readable,
    handshake_complete AND cert_seen AS full_handshake FROM s1),
ses AS (SELECT s2.*, CASE WHEN full_handshake THEN 'COMPLETE' WHEN tls_detected THEN 'PARTIAL' ELSE 'UNKNOWN' END AS handshake_status,
    CASE WHEN tls_detected AND NOT full_handshake THEN 'PARTIAL' ELSE 'COMPLETE' END AS stream_status,
    l.subject AS cert_subject, l.key_bits AS cert_key_bits, l.key_algorithm AS cert_key_algorithm, l.expired AS cert_expired, l.early AS cert_early,
    l.days_remaining AS cert_days, l.self_signed AS cert_self_signed, coalesce(l.weak_signature, FALSE) AS cert_weak_signature, l.weak_key AS cert_weak_key,
    l.sig_hash || '-' || l.key_algorithm AS cert_signature, l.common_name AS cert_cn, l.valid_from_epoch AS cert_from, l.valid_until_epoch AS cert_until,
    CASE WHEN l.stream_id IS NULL OR sni IS NULL THEN NULL WHEN l.san IS NULL THEN l.common_name = sni
      WHEN starts_with(l.san, '*.') THEN substr(sni, strpos(sni, '.') + 1) = substr(l.san, 3) ELSE lower(rtrim(l.san, '.')) = sni END AS cert_match,
    CASE WHEN l.stream_id IS NULL THEN 'UNKNOWN' WHEN k.stream_id IS NULL THEN CASE WHEN l.self_signed THEN 'SELF_SIGNED' ELSE 'INCOMPLETE' END
      WHEN NOT k.linked THEN 'INCOMPLETE' WHEN k.rooted THEN 'COMPLETE' ELSE 'COMPLETE_UNVERIFIED_ROOT' END AS chain_status,
    CASE WHEN l.stream_id IS NULL THEN 0 WHEN k.stream_id IS NULL THEN 1 ELSE 2 END AS chain_length,
    CASE WHEN l.stream_id IS NULL THEN NULL WHEN k.stream_id IS NULL THEN l.self_signed ELSE k.linked END AS chain_complete
    FROM s2 LEFT JOIN leaf l ON l.stream_id = s2.stream_id AND readable LEFT JOIN links k ON k.stream_id = s2.stream_id AND readable),
st AS (SELECT ses.*, CASE WHEN NOT readable THEN 'UNKNOWN' WHEN cert_expired THEN 'EXPIRED' WHEN cert_early THEN 'NOT_YET_VALID' WHEN NOT cert_match THEN 'HOSTNAME_MISMATCH'
    WHEN cert_weak_key THEN 'WEAK_KEY' WHEN cert_weak_signature THEN 'WEAK_SIGNATURE' WHEN cert_self_signed THEN 'SELF_SIGNED' ELSE 'VALID' END AS cert_status FROM ses)
"""

# code -> (condition, evidence) on a row of ``st``
UTC = "strftime(make_timestamp(CAST({} AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') || '+00:00'"
INSECURE = "regexp_matches(upper(coalesce(cipher_suite, '')), 'NULL|EXPORT|RC4|RC2|ANON')"
TRIPLE = "regexp_matches(upper(coalesce(cipher_suite, '')), '3DES|DES-CBC3')"
RULE_SQL = {
    "PLAINTEXT_EMAIL_SESSION": ("protocol <> 'UNKNOWN' AND NOT tls_detected", "'Protocol: ' || protocol || ';Server port: ' || server_port"),
    "PLAINTEXT_AUTHENTICATION": ("plaintext_auth", "'Plaintext authentication pattern observed;' || evidence"),
    "DEPRECATED_TLS_VERSION": ("tls_version IN ('SSLv3', 'TLS 1.0')", "'Negotiated version: ' || tls_version"),
    "LEGACY_TLS_VERSION": ("tls_version = 'TLS 1.1'", "'Negotiated version: TLS 1.1'"),
    "TLS_VERSION_UNKNOWN": ("tls_detected AND tls_version IS NULL", "'Handshake evidence is incomplete'"),
    "INSECURE_CIPHER": (INSECURE, "'Cipher suite: ' || cipher_suite"),
    "LEGACY_CIPHER": (f"NOT {INSECURE} AND {TRIPLE}", "'Cipher suite: ' || cipher_suite"),
    "LEGACY_CBC_CIPHER": (f"NOT {INSECURE} AND NOT {TRIPLE} AND cipher_suite LIKE '%CBC%' AND tls_version IN ('TLS 1.0', 'TLS 1.1', 'TLS 1.2')", "'Cipher suite: ' || cipher_suite"),
    "CIPHER_NOT_RECOGNISED": ("tls_detected AND cipher_suite IS NOT NULL AND NOT cipher_known", "'Negotiated cipher suite: ' || cipher_suite"),
    "NO_FORWARD_SECRECY": ("forward_secrecy IS FALSE", "'Key exchange: ' || coalesce(key_exchange, 'UNKNOWN')"),
    "FORWARD_SECRECY_UNKNOWN": ("tls_detected AND forward_secrecy IS NULL", "'Forward secrecy: UNKNOWN'"),
    "CERTIFICATE_EXPIRED": ("cert_expired", "'Valid until: ' || " + UTC.format("cert_until")),
    "CERTIFICATE_NOT_YET_VALID": ("NOT cert_expired AND cert_early", "'Valid from: ' || " + UTC.format("cert_from")),
    "CERTIFICATE_EXPIRING_SOON": ("NOT cert_expired AND NOT cert_early AND cert_days <= 30", "'Days remaining: ' || cert_days"),
    "WEAK_CERTIFICATE_KEY": ("cert_key_algorithm = 'RSA' AND cert_key_bits < 2048", "'Public key: RSA ' || cert_key_bits || ' bits'"),
    "WEAK_CERTIFICATE_SIGNATURE": ("cert_weak_signature", "'Signature: ' || cert_signature"),
    "SELF_SIGNED_CERTIFICATE": ("cert_self_signed", "'Subject and issuer: ' || cert_subject"),
    "CERTIFICATE_HOSTNAME_MISMATCH": ("cert_match IS FALSE", "'SNI: ' || coalesce(sni, 'None') || ';Certificate CN: ' || cert_cn"),
    "INCOMPLETE_CERTIFICATE_CHAIN": ("chain_complete IS FALSE", "'Chain status: ' || chain_status"),
    "CERTIFICATE_NOT_OBSERVED": ("NOT cert_present AND tls_detected", "'Certificate: UNKNOWN'"),
    "STARTTLS_REJECTED": ("starttls_command AND starttls_rejected", "'STARTTLS/STLS command observed;Server rejection observed'"),
    "STARTTLS_UPGRADE_NOT_COMPLETED": ("starttls_command AND NOT starttls_rejected AND NOT upgrade_successful AND NOT tls_detected", "'STARTTLS/STLS command observed;TLS handshake not observed'"),
    "TLS_HANDSHAKE_INSTABILITY": ("alert_seen OR failures > 0", "'TLS failures: ' || failures || ';TLS alert observed: ' || CASE WHEN alert_seen THEN 'True' ELSE 'False' END"),
}
RULES_TABLE = "rules(pos, code, severity, impact, confidence, title, advice) AS (VALUES " + ", ".join(
    f"({i}, {q(c)}, {q(s)}, {w}, {q(conf)}, {q(t)}, {q(a)})" for i, (c, s, w, conf, t, _, a) in enumerate(RULES)) + ")"
FINDINGS = f"""{RULES_TABLE},
fnd AS (SELECT st.capture, st.session_id, st.first_frame, r.pos, r.code, r.confidence, r.advice,
    CASE WHEN r.code = 'PLAINTEXT_EMAIL_SESSION' AND plaintext_auth THEN 'HIGH' ELSE r.severity END AS severity,
    CASE WHEN r.code = 'PLAINTEXT_EMAIL_SESSION' AND plaintext_auth THEN 30 ELSE r.impact END AS score_impact,
    CASE WHEN r.code = 'DEPRECATED_TLS_VERSION' THEN r.title || tls_version ELSE r.title END AS title,
    CASE r.code {' '.join(f"WHEN {q(c)} THEN {e}" for c, (_, e) in RULE_SQL.items())} END AS evidence
    FROM st CROSS JOIN rules r WHERE coalesce(CASE r.code {' '.join(f"WHEN {q(c)} THEN ({w})" for c, (w, _) in RULE_SQL.items())} END, FALSE))"""
ORDER_OF = "CASE {} WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
PENALTIES = """(CASE WHEN tls_detected AND v <= 2 THEN 45 ELSE 0 END + CASE WHEN tls_detected AND v = 3 THEN 30 ELSE 0 END
    + CASE WHEN tls_detected AND cipher_strength <= 20 THEN 45 WHEN tls_detected AND cipher_strength <= 55 THEN 18 ELSE 0 END
    + CASE WHEN forward_secrecy IS FALSE THEN 18 ELSE 0 END + CASE WHEN NOT tls_detected AND protocol <> 'UNKNOWN' THEN 35 ELSE 0 END
    + CASE WHEN plaintext_auth THEN 45 ELSE 0 END
    + CASE WHEN cert_present AND cert_expired THEN 30 ELSE 0 END + CASE WHEN cert_present AND cert_self_signed THEN 18 ELSE 0 END
    + CASE WHEN cert_present AND cert_key_bits > 0 AND cert_key_bits < 2048 THEN 25 ELSE 0 END + CASE WHEN cert_present AND cert_weak_signature THEN 18 ELSE 0 END
    + CASE WHEN cert_present AND cert_match IS FALSE THEN 25 ELSE 0 END + CASE WHEN cert_present AND chain_complete IS FALSE THEN 12 ELSE 0 END
    + CASE WHEN NOT cert_present AND tls_detected AND NOT handshake_complete THEN 4 ELSE 0 END + CASE WHEN failures > 0 THEN 12 ELSE 0 END)"""
BAND = "CASE WHEN {0} >= 80 THEN 'CRITICAL' WHEN {0} >= 45 THEN 'HIGH' WHEN {0} >= 18 THEN 'MEDIUM' ELSE 'LOW' END"
SCORED = f"""
tot AS (SELECT capture, session_id, sum(score_impact) AS raw, max({ORDER_OF.format('severity')}) AS worst, count(*) AS n_findings,
    string_agg(DISTINCT code, '|' ORDER BY code) AS codes, list(DISTINCT code) AS code_list FROM fnd GROUP BY capture, session_id),
sc0 AS (SELECT st.*, CAST(least(100, coalesce(raw, 0)) AS INT) AS policy_risk_score, coalesce(worst, 0) AS worst, coalesce(n_findings, 0) AS n_findings,
    coalesce(codes, '') AS codes, coalesce(code_list, []::VARCHAR[]) AS code_list, {rank('tls_version')} AS v,
    round_even((CAST(protocol <> 'UNKNOWN' AS INT) + 1 + CAST(NOT tls_detected OR tls_version IS NOT NULL AS INT)
      + CAST(NOT tls_detected OR cipher_suite IS NOT NULL AS INT) + CAST(NOT tls_detected OR cert_present AS INT)) / 5.0, 2) AS evidence_completeness
    FROM st LEFT JOIN tot USING (capture, session_id)),
sc AS (SELECT sc0.*, 100 - policy_risk_score AS posture_score, {PENALTIES} AS label_score, {BAND.format(PENALTIES)} AS ml_class,
    CASE WHEN policy_risk_score >= 80 OR worst = 4 THEN 'CRITICAL' WHEN worst = 3 THEN 'HIGH' WHEN worst = 2 THEN 'MEDIUM' ELSE 'LOW' END AS policy_risk_class FROM sc0)"""

TO_SESSIONS = f"WITH {PACKETS}, {CERTS}, {SUITES}, {SESSIONS}"
TO_FINDINGS = f"{TO_SESSIONS}, {FINDINGS}"
TO_SCORED = f"{TO_FINDINGS}, {SCORED}"
TO_PACKETS = f"WITH {PACKETS}"


def ses(columns: str) -> str:
    return f"{TO_SESSIONS} SELECT capture, CAST(stream_id AS VARCHAR) AS stream_id, {columns} FROM st"


def scored(select: str) -> str:
    return f"{TO_SCORED} {select}"


SQL: dict[str, str] = {}

# ------------------------------------------------------------------ S
FILES = """files AS (SELECT '/work/' || ['samples','samples/lab','samples/sweep','data','reports','testset','field'][page_id % 7 + 1] || '/cap-' || page_id
    || ['.pcap','.PCAPNG','.cap','.pcap.gz','.txt','.html'][page_id % 6 + 1] AS path, page_id, length(html) AS length FROM pages),
manifest AS (SELECT path, length FROM files WHERE regexp_matches(lower(path), '\\.(pcap|pcapng|cap|pcap\\.gz|cap\\.gz)$')
    AND NOT regexp_matches(path, '/(data|reports|__pycache__|\\.git|\\.venv)/'))"""
SQL["S1_capture_manifest"] = f"WITH {FILES} SELECT path, length FROM manifest"
SQL["S2_content_digest"] = "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM documents"
EXPORTED = [    # layer, key below it, value or list of values; in the order of the export
    ("frame", "frame.number", "CAST(frame AS VARCHAR)"), ("frame", "frame.time.epoch", "CAST(ts_us // 1000000 AS VARCHAR) || '.' || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0')"),
    ("frame", "frame.len", "CAST(frame_len AS VARCHAR)"), ("ip", "ip.src", "src_ip"), ("ip", "ip.dst", "dst_ip"), ("tcp", "tcp.stream", "CAST(stream_id AS VARCHAR)"),
    *[("tcp", f"tcp.{key}", f"CASE WHEN stream_id % 3 = 0 THEN '0x' || lower(to_hex({column})) ELSE CAST({column} AS VARCHAR) END") for key, column in (("srcport", "src_port"), ("dstport", "dst_port"))],
    ("tcp", "tcp.len", "'20'"), ("tcp", "tcp.analysis.retransmission", "CASE WHEN retransmission THEN '1' END"),
    *[(layer, f"{layer}.{key}", f"CASE WHEN spoken = '{protocol}' AND mail_text IS NOT NULL {where} THEN {value} END") for protocol, layer in (("SMTP", "smtp"), ("IMAP", "imap"), ("POP3", "pop"))
      for key, where, value in (("request", "AND src_port > 30000", "mail_text"), ("response", "AND NOT src_port > 30000", "mail_text"), ("data.fragment", "", "'USER never read'"))],
    *[("tls", key, f"CASE WHEN is_tls {where} THEN {value} END") for key, where, value in (
        ("tls.record.content.type", "", "CASE WHEN hs_type IS NOT NULL THEN '22' ELSE '23' END"),
        ("tls.handshake.type", "AND hs_type IS NOT NULL", "CASE WHEN n_certs > 0 THEN '2,11,12' ELSE CAST(hs_type AS VARCHAR) END"),
        ("tls.handshake.version", "AND hs_type IS NOT NULL", "legacy"), ("tls.handshake.ciphersuites.length", "AND hs_type IS NOT NULL", "'8'"),
        ("tls.handshake.ciphersuite", "", "string_split(suites, ',')"), ("tls.handshake.extensions.supported.version", "", "string_split(supported, ',')"),
        ("tls.handshake.extensions.server.name.len", "AND sni IS NOT NULL", "'13'"), ("tls.handshake.extensions.server.name", "", "sni"),
        ("tls.handshake.extensions.key.share.group", "", "key_group"), ("tls.handshake.certificates.length", "AND n_certs > 0", "'120'"),
        ("tls.handshake.certificate", "", "CASE WHEN n_certs >= 2 THEN [hex(repeat(leaf_text, 8)), hex(repeat(issuer_text, 8))] WHEN n_certs >= 1 THEN [hex(repeat(leaf_text, 8))] END"),
        ("tls.alert.message.desc", "AND alert", "CASE WHEN failure THEN 'Handshake Failure' ELSE 'Close Notify' END"))],
]
LISTS = ("tls.handshake.ciphersuite", "tls.handshake.extensions.supported.version", "tls.handshake.certificate")


def exported_pairs(alias: bool) -> str:
    """All key=value pairs of a packet, in order; ``alias`` is the spelling with underscores, which repeats the layer."""
    parts = []
    for layer, key, value in EXPORTED:
        full = f"{layer}.{layer}.{key}" if alias else f"{layer}.{key}"
        parts.append(f"coalesce(list_transform({value}, lambda v: '{full}=' || v), [])" if key in LISTS
                     else f"list_filter(['{full}=' || {value}], lambda v: v IS NOT NULL)")
    return "flatten([" + ", ".join(parts) + "])"


SQL["S3_packet_export_scan"] = f"""{TO_PACKETS}, exported AS (SELECT capture, row_number() OVER (PARTITION BY capture ORDER BY frame) AS packet_no,
    CASE WHEN stream_id % 2 = 1 THEN {exported_pairs(True)} ELSE {exported_pairs(False)} END AS pairs FROM packets)
  SELECT capture, packet_no, CAST(len(pairs) AS INT) AS n_fields, array_to_string(pairs, ';') AS fields FROM exported"""
SQL["S4_field_subset_scan"] = f"{TO_PACKETS} SELECT suite, count(*) AS n FROM (SELECT unnest(string_split(suites, ',')) AS suite FROM packets WHERE is_tls AND suites IS NOT NULL) u GROUP BY suite"
SQL["S5_mail_scope"] = f"{TO_PACKETS} SELECT capture, count(*) AS packets, CAST(sum(frame_len) AS BIGINT) AS bytes FROM packets WHERE (src_port IN {STANDARD} OR dst_port IN {STANDARD}) AND src_port <> 995 AND dst_port <> 995 GROUP BY capture"
SUMMARY = f"""
smy AS (SELECT capture, count(*) AS total_sessions, count(*) FILTER (tls_detected) AS tls_sessions,
    count(*) FILTER (NOT tls_detected AND protocol <> 'UNKNOWN') AS plaintext_sessions, count(*) FILTER (starttls_command OR starttls_advertised) AS starttls_sessions,
    count(*) FILTER (upgrade_successful) AS successful_upgrades, CAST(0 AS BIGINT) AS anomalous_sessions, CAST(sum(n_findings) AS BIGINT) AS total_findings,
    CAST(round_even(avg(policy_risk_score), 0) AS INT) AS overall_risk_score, 100 - CAST(round_even(avg(policy_risk_score), 0) AS INT) AS overall_posture_score,
    ['LOW','MEDIUM','HIGH','CRITICAL'][greatest(max({ORDER_OF.format('policy_risk_class')}), 1)] AS overall_risk_class,
    round_even(avg(evidence_completeness), 2) AS evidence_completeness, count(*) FILTER (ml_class = policy_risk_class) AS ml_matches_rules FROM sc GROUP BY capture),
sev AS (SELECT capture, {', '.join(f"count(*) FILTER (severity = {q(s)}) AS severity_{s.lower()}" for s in SEVERITIES)} FROM fnd GROUP BY capture),
best AS (SELECT capture, code, severity, title, score_impact, first_frame, session_id, pos,
    row_number() OVER (PARTITION BY capture, code ORDER BY score_impact DESC, first_frame, session_id, pos) AS k FROM fnd),
top AS (SELECT capture, code, severity, title, score_impact, row_number() OVER (PARTITION BY capture ORDER BY score_impact DESC, first_frame, session_id, pos) AS rank FROM best WHERE k = 1)"""


def counter(column: str, glue: str, join: str) -> str:
    return f"(SELECT coalesce(string_agg(x.k || '{glue}' || x.n, '{join}' ORDER BY x.k), '') FROM (SELECT {column} AS k, count(*) AS n FROM sc WHERE sc.capture = smy.capture AND {column} IS NOT NULL GROUP BY 1) x)"


SQL["S6_capture_records"] = scored(f""", {SUMMARY.lstrip()} SELECT capture, '{{"total_sessions":' || total_sessions || ',"total_findings":' || total_findings || ',"overall_risk_class":"' || overall_risk_class || '"}}' AS record FROM smy""")
SQL["S7_capture_csv"] = scored(f""", {SUMMARY.lstrip()} SELECT capture, TRUE AS ok, CAST(0.0 AS DOUBLE) AS seconds, CAST(0 AS BIGINT) AS size_bytes, total_sessions AS sessions, tls_sessions, plaintext_sessions AS cleartext_sessions,
  starttls_sessions, successful_upgrades, total_findings, severity_critical, severity_high, severity_medium, severity_low, severity_info, overall_posture_score AS posture,
  overall_risk_class AS risk_class, overall_risk_score AS risk_score, evidence_completeness, ml_matches_rules, '' AS ml_status,
  {counter('protocol', '=', '; ')} AS protocols, {counter('tls_version', '=', '; ')} AS tls_versions,
  (SELECT string_agg(severity || ':' || code, ' | ' ORDER BY rank) FROM top WHERE top.capture = smy.capture AND rank <= 5) AS top_findings, '' AS error
  FROM smy JOIN sev USING (capture)""")
FEATURE_SQL = {
    "server_port": "coalesce(server_port, 0)", "packet_count": "packet_count", "byte_count": "byte_count", "duration_ms": "duration_ms",
    "retransmission_rate": "CAST(retransmission_count AS DOUBLE) / packet_count", "handshake_failure_count": "failures", "tls_detected": "CAST(tls_detected AS INT)",
    "tls_version_rank": rank("tls_version"), "cipher_strength_score": "cipher_strength",
    "key_exchange_code": "CASE key_exchange WHEN 'RSA' THEN 1 WHEN 'DHE' THEN 2 WHEN 'ECDHE' THEN 3 WHEN 'TLS 1.3 ephemeral' THEN 4 ELSE 0 END",
    "forward_secrecy": "coalesce(CAST(forward_secrecy AS INT), -1)", "starttls_advertised": "CAST(starttls_advertised AS INT)",
    "starttls_success": "CAST(upgrade_successful AS INT)", "plaintext_authentication": "CAST(plaintext_auth AS INT)", "certificate_present": "CAST(cert_present AS INT)",
    "certificate_expired": "coalesce(CAST(cert_expired AS INT), 0)", "certificate_self_signed": "coalesce(CAST(cert_self_signed AS INT), 0)",
    "certificate_key_bits": "coalesce(cert_key_bits, 0)", "certificate_signature_strength": "CASE WHEN cert_weak_signature THEN 1 WHEN cert_present THEN 3 ELSE 0 END",
    "hostname_match": "coalesce(CAST(cert_match AS INT), -1)", "chain_complete": "coalesce(CAST(chain_complete AS INT), -1)", "sni_present": "CAST(sni IS NOT NULL AS INT)",
    "handshake_complete": "CAST(handshake_complete AS INT)", "repeated_client_hellos": "repeated", "cipher_rarity": "0.0", "certificate_changed": "0",
}
SQL["S8_feature_table"] = scored("SELECT capture, session_id, protocol, tls_version, cipher_suite, policy_risk_class AS risk_label, ml_class AS ml_label, policy_risk_score AS risk_score, evidence_completeness, CAST(n_findings AS INT) AS finding_count, codes AS finding_codes, "
                                 + ", ".join(f"CAST({FEATURE_SQL[n]} AS DOUBLE) AS {n}" for n in FEATURES) + " FROM sc")
SQL["S9_split_failures"] = """SELECT '/work/' || event_id AS path, CASE WHEN event_id % 10 <> 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 10 = 3 THEN 'unreadable record: broken ' || props END AS error FROM events"""
SQL["S10_resume_pending"] = f"WITH {FILES} SELECT path FROM manifest WHERE path NOT IN (SELECT path FROM files WHERE length > 500 AND page_id % 4 = 0)"
ANALYSES = """analyses AS (SELECT 'a' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS analysis_id, source || '-' || (doc_id % 17) || '.pcapng' AS source_filename,
  (doc_id * 7919) % 1000003 AS created_at, CASE WHEN doc_id % 5 = 0 THEN '3.1.0' ELSE '3.2.0' END AS analyzer_version, n_chars AS size_bytes FROM documents)"""
SQL["S11_load_analysis"] = f"WITH {ANALYSES} SELECT analysis_id, source_filename, size_bytes FROM analyses WHERE analysis_id = 'a000000042'"
SHIPPED = "(capture LIKE '%1' OR capture LIKE '%4')"
CAPTURE_TEXT = "string_agg(session_id || ',' || protocol || ',' || policy_risk_class, chr(10) ORDER BY session_id || ',' || protocol || ',' || policy_risk_class) || chr(10)"
SQL["S12_dataset_release"] = scored(f"""SELECT CASE WHEN {SHIPPED} THEN 'kept' ELSE 'dropped' END AS name, count(*) AS n, NULL::VARCHAR AS sha256 FROM sc GROUP BY 1
  UNION ALL SELECT 'label ' || policy_risk_class, count(*), NULL FROM sc WHERE {SHIPPED} GROUP BY 1
  UNION ALL SELECT 'file ' || capture, CAST(octet_length(encode({CAPTURE_TEXT})) AS BIGINT), sha256({CAPTURE_TEXT}) FROM sc WHERE {SHIPPED} GROUP BY capture""")

# ------------------------------------------------------------------ T
SQL["T1_norm_key"] = "SELECT upper(event_type) || '_Frame.Len_X' AS raw, replace(lower(upper(event_type) || '_Frame.Len_X'), '_', '.') AS norm, count(*) AS n FROM events GROUP BY event_type"


def pkt(columns: str) -> str:
    return f"{TO_PACKETS} SELECT frame AS packet_no, {columns} FROM packets"


SQL["T2_field_values"] = pkt("CAST(CASE WHEN mail_text IS NULL THEN 0 ELSE 2 END AS INT) AS hits, CASE WHEN hs_type IS NOT NULL THEN '8,' || suites ELSE '' END AS suites, dst_ip AS first")
SQL["T3_field_int"] = pkt("CAST(src_port AS BIGINT) AS src_port, frame, ts_us // 1000000 AS seconds")
SQL["T4_tls_version_name"] = pkt("CASE legacy WHEN '0x0303' THEN 'TLS 1.2' WHEN '0x0302' THEN 'TLS 1.1' WHEN '0x0301' THEN 'TLS 1.0' END AS version, CASE WHEN supported IS NOT NULL THEN 'TLS 1.3' END AS supported")
SQL["T5_handshake_types"] = pkt("CASE WHEN n_certs > 0 THEN '11,12,2' WHEN hs_type IS NOT NULL THEN CAST(hs_type AS VARCHAR) ELSE '' END AS types")
SQL["T6_cipher_values"] = pkt("coalesce(suites, '') AS suites")
SQL["T7_packet_time"] = pkt("ts_us, CAST(NULL AS DOUBLE) AS relative")
SQL["T8_mail_text"] = pkt("mail_text AS said")
SQL["T9_packet_protocol"] = pkt(f"coalesce(CASE WHEN mail_text IS NOT NULL THEN spoken END, {port_protocol('src_port')}, {port_protocol('dst_port')}, 'UNKNOWN') AS protocol")
SQL["T10_ip_value"] = pkt("src_ip, CASE WHEN stream_id % 3 <> 0 THEN CAST(src_port AS VARCHAR) END AS hex_guard")
SQL["T11_sni_value"] = pkt("sni")
SQL["T12_certificate_values"] = pkt("CAST(CASE WHEN n_certs > 0 THEN n_certs + 1 ELSE 0 END AS INT) AS n, CAST(CASE n_certs WHEN 1 THEN 16 * length(leaf_text) WHEN 2 THEN 16 * length(issuer_text) END AS INT) AS last_length")
SQL["T13_tls_flags"] = pkt("is_tls, coalesce(hs_type = 1, FALSE) AS client_hello, coalesce(hs_type = 2, FALSE) AS server_hello, alert, failure")
SQL["T14_frame_facts"] = pkt("retransmission, frame_len")
LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
SQL["T15_upgrade_verdict"] = (f"{TO_PACKETS}, {LINES} SELECT frame AS packet_no, {verdict('mail_text')} AS untagged, " + verdict('mail_text', "'a001'") + " AS tagged FROM packets WHERE mail_text IS NOT NULL "
                              f"UNION ALL SELECT -doc_id * 100000 - pos - 1, {verdict('line')}, " + verdict('line', "'a001'") + " FROM lines")
SQL["T16_clear_auth"] = f"{TO_PACKETS}, said AS (SELECT frame AS packet_no, mail_text AS t FROM packets WHERE mail_text IS NOT NULL UNION ALL SELECT -doc_id - 1, text FROM documents) SELECT packet_no, {clear_auth('t', 'SMTP')} AS smtp, {clear_auth('t', 'IMAP')} AS imap, {clear_auth('t', 'POP3')} AS pop3 FROM said"
SQL["T17_starttls_command"] = f"""{TO_PACKETS} SELECT frame AS packet_no, regexp_matches(mail_text, '(?i)(^|[^A-Za-z])(STARTTLS|STLS)\\b') AS asks,
  nullif(regexp_extract(mail_text, '(?i)^([A-Za-z0-9*+._-]{{1,16}}) +(STARTTLS|STLS)\\b', 1), '') AS tag, regexp_matches(mail_text, '(?i)\\b(STARTTLS|STLS)\\b') AS mentions FROM packets WHERE mail_text IS NOT NULL"""

# ------------------------------------------------------------------ D
TOKENS = " OR ".join(f"contains(mail_text, {q(t)})" for t in PAYLOAD_TOKENS)


def vocabulary(text: str, protocol: str) -> str:
    return " + ".join(f"(length({text}) - length(replace({text}, {q(t)}, ''))) // {len(t)}" for t in MAIL_VOCABULARY[protocol])


CANDIDATES = f"""cand AS (SELECT *, lower(mail_text) AS low FROM packets WHERE {TOKENS}),
votes AS (SELECT capture, port, protocol, CAST(sum(score) AS BIGINT) AS score FROM (
    SELECT capture, unnest([src_port, dst_port]) AS port, 'SMTP' AS protocol, {vocabulary('low', 'SMTP')} AS score FROM cand
    UNION ALL SELECT capture, unnest([src_port, dst_port]), 'IMAP', {vocabulary('low', 'IMAP')} FROM cand
    UNION ALL SELECT capture, unnest([src_port, dst_port]), 'POP3', {vocabulary('low', 'POP3')} FROM cand) v GROUP BY ALL HAVING sum(score) > 0),
greet AS (SELECT capture, protocol, arg_min(src_port, frame) AS port FROM (
    {' UNION ALL '.join(f"SELECT capture, frame, src_port, {q(p)} AS protocol FROM cand WHERE " + ' OR '.join(f"starts_with(ltrim(low), {q(w)})" for w in ws) for p, ws in SERVER_GREETINGS.items())}) g GROUP BY capture, protocol),
hint AS (SELECT capture, port, protocol, score FROM votes v WHERE port NOT IN {STANDARD} AND score >= 3
    AND NOT EXISTS (SELECT 1 FROM votes w WHERE w.capture = v.capture AND w.port = v.port AND w.protocol <> v.protocol AND w.score >= v.score)),
named AS (SELECT hint.capture, hint.port, hint.protocol FROM hint JOIN greet USING (capture, port, protocol)),
found AS (SELECT * FROM named UNION ALL SELECT capture, port, protocol FROM hint WHERE capture NOT IN (SELECT capture FROM named)
    AND capture NOT IN (SELECT capture FROM greet WHERE port IN {STANDARD}))"""
TO_FOUND = f"{TO_PACKETS}, {CANDIDATES}"
PAIRED = PACKETS.replace("SELECT *,", "SELECT * REPLACE ('s' || (stream_id // 2) AS capture),", 1)
SQL["D1_payload_prefilter"] = f"{TO_FOUND} SELECT capture, frame AS packet_no, src_port, mail_text AS text FROM cand"
SQL["D2_vocabulary_scores"] = "WITH low AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, " + ", ".join(f"CAST({vocabulary('t', p)} AS INT) AS {p.lower()}" for p in MAIL_VOCABULARY) + " FROM low"
SQL["D3_port_votes"] = f"{TO_FOUND} SELECT * FROM votes"
SQL["D4_first_greeting"] = f"{TO_FOUND} SELECT * FROM greet"
SQL["D5_port_hints"] = f"{TO_FOUND} SELECT * FROM hint"
SQL["D6_discovered_ports"] = f"WITH {PAIRED}, {CANDIDATES} SELECT * FROM found"
# Second pass: streams on a found port, the server side known by it.
SQL["D7_merge_passes"] = f"""WITH {PAIRED}, {CERTS}, {SUITES}, {SESSIONS}, {CANDIDATES},
std AS (SELECT capture, session_id, protocol, server_port, client_port, packet_count, plaintext_auth, starttls_rejected, upgrade_successful FROM st WHERE server_port IN {STANDARD}),
ext AS (SELECT p.capture, p.stream_id, p.idx, f.protocol, f.port, CASE WHEN p.src_port = f.port THEN p.dst_port ELSE p.src_port END AS client_port, p.dst_port = f.port AS from_client,
    p.is_tls, CASE WHEN NOT p.is_tls THEN p.mail_text END AS said FROM packets p JOIN found f ON f.capture = p.capture AND f.port IN (p.src_port, p.dst_port)),
eagg AS (SELECT capture, stream_id, any_value(protocol) AS protocol, any_value(port) AS server_port, any_value(client_port) AS client_port, count(*) AS packet_count, min(idx) FILTER (is_tls) AS t_idx,
    min(idx) FILTER (from_client AND CASE protocol WHEN 'SMTP' THEN {clear_auth('said', 'SMTP')} WHEN 'IMAP' THEN {clear_auth('said', 'IMAP')} ELSE {clear_auth('said', 'POP3')} END) AS auth_idx,
    min(idx) FILTER (from_client AND regexp_matches(said, '(?i)(^|[^A-Za-z])(STARTTLS|STLS)\\b')) AS cmd_idx,
    bool_or(NOT from_client AND idx = 3 AND regexp_matches(said, '(?i)^(a001 NO|454 |-ERR)')) AS refused FROM ext GROUP BY capture, stream_id)
SELECT * FROM std UNION ALL SELECT capture, 'tcp.stream.' || stream_id, protocol, server_port, client_port, packet_count, auth_idx IS NOT NULL AND (t_idx IS NULL OR auth_idx < t_idx),
  coalesce(cmd_idx IS NOT NULL AND refused, FALSE), coalesce(cmd_idx <= t_idx, FALSE) FROM eagg"""
LEFT = f"""lft AS (SELECT capture, 'tcp.stream.' || stream_id AS session_id, stream_id, CAST(min(least(src_port, dst_port)) AS INT) AS server_port, CAST(max(greatest(src_port, dst_port)) AS INT) AS client_port,
  max(server_version) AS tls_version, CASE WHEN max(server_version) IS NULL THEN 'UNKNOWN' WHEN max(server_version) = 'TLS 1.3' THEN 'SERVER_HELLO' ELSE 'SERVER_HELLO_LEGACY' END AS tls_version_source,
  max(sni) AS server_name, bool_or(n_certs > 0) AS certificate_visible FROM packets WHERE is_tls AND src_port NOT IN {STANDARD} AND dst_port NOT IN {STANDARD} GROUP BY capture, stream_id)"""
SQL["D8_unclassified_tls"] = f"{TO_PACKETS}, {LEFT} SELECT capture, session_id, server_port, client_port, tls_version, tls_version_source, server_name, certificate_visible FROM lft"
SQL["D9_unclassified_note"] = f"""{TO_PACKETS}, {LEFT}, ports AS (SELECT capture, server_port, min(stream_id) AS first FROM lft GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY first, server_port) AS k, count(*) OVER (PARTITION BY capture) AS np FROM ports)
  SELECT capture, (SELECT count(*) FROM lft WHERE lft.capture = ranked.capture) AS n, (SELECT count(*) FROM lft WHERE lft.capture = ranked.capture) || ' encrypted stream(s) were not attributed to a mail protocol (ports: '
   || string_agg(server_port, ', ' ORDER BY k) FILTER (k <= 6) || CASE WHEN max(np) > 6 THEN ' (+' || (max(np) - 6) || ' more)' ELSE '' END
   || '). The protocol inside them cannot be proven from the capture, because implicit TLS hides all protocol vocabulary.' AS note FROM ranked GROUP BY capture"""
SQL["D9_stream_description"] = f"""{TO_PACKETS}, {LEFT} SELECT capture, session_id, 'port ' || server_port || ', ' || coalesce(tls_version || ' (from ' || tls_version_source || ')', 'TLS version UNKNOWN')
  || coalesce(', client asked for ' || server_name, '') || CASE WHEN certificate_visible THEN ', certificate visible' ELSE ', certificate NOT observable' END AS description FROM lft"""
SQL["D10_capture_state"] = f"""{TO_PACKETS}, e AS (SELECT *, 'u' || (stream_id // 10) AS cap, src_port IN {STANDARD} OR dst_port IN {STANDARD} AS std FROM packets),
  listed AS (SELECT DISTINCT 'u' || ((user_id * 1000 + event_id % 30) // 10) AS capture FROM events),
  per AS (SELECT cap AS capture, count(DISTINCT stream_id) FILTER (std) AS sessions, count(DISTINCT stream_id) FILTER (NOT std AND is_tls) AS streams, count(*) AS n FROM e GROUP BY cap)
  SELECT capture, coalesce(sessions, 0) AS sessions, coalesce(streams, 0) AS streams, CASE WHEN sessions > 0 THEN 'SCORED' WHEN streams > 0 THEN 'UNCLASSIFIED' WHEN n IS NULL THEN 'UNREADABLE' ELSE 'NO_SESSIONS' END AS state
  FROM listed LEFT JOIN per USING (capture)"""

# ------------------------------------------------------------------ A
SQL["A1_packet_index"] = f"{TO_PACKETS} SELECT capture, CAST(stream_id AS VARCHAR) AS stream_id, frame AS packet_no, CAST(idx AS BIGINT) AS packet_index FROM packets"
SQL["A2_endpoints"] = ses("client_ip, client_port, server_ip, server_port")
SQL["A3_direction"] = f"{TO_SESSIONS} SELECT frame AS packet_no, from_client FROM dir"
SQL["A4_volume"] = ses("packet_count, byte_count, retransmission_count, first_frame, last_frame")
SQL["A5_duration_ms"] = ses("duration_ms")
SQL["A6_protocol_vote"] = ses("protocol, CAST(protocol_confidence AS DOUBLE) AS protocol_confidence")
SQL["A7_upgrade_success"] = ses("starttls_command, upgrade_successful, implicit_tls")
SQL["A8_starttls_response"] = ses("answered_yes, answered_no")
SQL["A9_starttls_advertised"] = ses("starttls_advertised")
SQL["A10_plaintext_auth"] = ses("plaintext_auth")
SQL["A11_starttls_outcome"] = ses("starttls_accepted, starttls_rejected, evidence")
SQL["A12_tls_detected"] = ses("tls_detected, implicit_tls")
SQL["A13_negotiated_version"] = ses("tls_version, version_source, offered_versions AS offered")
SQL["A14_negotiated_cipher"] = ses("cipher_suite, cipher_source, key_exchange, forward_secrecy, cipher_strength, coalesce(offered, '') AS offered")
SQL["A15_handshake_facts"] = ses("ch AS client_hello_seen, sh AS server_hello_seen, cert_seen AS certificate_seen, repeated AS repeated_client_hellos, alert_seen, failures AS handshake_failures, sni, named_group")
SQL["A16_handshake_status"] = ses("handshake_status, stream_status")
SQL["A17_session_features"] = f"{TO_SESSIONS} SELECT capture, session_id, " + ", ".join(f"CAST({FEATURE_SQL[n]} AS DOUBLE) AS f_{n}" for n in FEATURES) + " FROM st"
SQL["A18_session_record"] = scored("SELECT capture, session_id, CAST(stream_id AS VARCHAR) AS tcp_stream_id, protocol, start_us, tls_version, TRUE AS resumed_unknown, starttls_accepted AS accepted, cert_subject AS subject, policy_risk_score, policy_risk_class FROM sc")

# ------------------------------------------------------------------ C
SQL["C1_resolve_cipher"] = f"""{TO_PACKETS}, {SUITES}, vals AS (SELECT DISTINCT value FROM (SELECT unnest(string_split(suites, ',')) AS value FROM packets WHERE is_tls
  UNION ALL SELECT 'TLS_ECDHE_' || upper(translate(p_type, ' #', '__')) || '_GCM_' || p_size FROM part) u WHERE value IS NOT NULL)
  SELECT value, CASE WHEN regexp_matches(value, '^0x') THEN value END AS code, CASE WHEN regexp_matches(value, '^0x') THEN name ELSE value END AS name,
  {display('value', 's')} AS display, CASE WHEN regexp_matches(value, '^0x') THEN kx WHEN contains(value, 'ECDHE') THEN 'ECDHE' ELSE 'RSA' END AS key_exchange,
  CASE WHEN regexp_matches(value, '^0x') THEN kx <> 'RSA' ELSE contains(value, 'ECDHE') END AS forward_secrecy,
  CASE WHEN regexp_matches(value, '^0x') THEN coalesce(strength, 0) WHEN contains(value, '_GCM_') THEN 90 ELSE 55 END AS strength, NOT regexp_matches(value, '^0x') OR name IS NOT NULL AS known
  FROM vals LEFT JOIN suites s ON s.code = value"""
SQL["C2_signalling"] = f"WITH c AS (SELECT DISTINCT '0x' || lower(lpad(to_hex(l_partkey * 26 % 65536), 4, '0')) AS code FROM lineitem) SELECT code, {signalling('code')} AS signalling FROM c"
MATCH = """CASE WHEN san IS NULL THEN lower(substr(subject, 4)) = {0} WHEN starts_with(san, '*.') THEN strpos({0}, '.') > 0 AND substr({0}, strpos({0}, '.') + 1) = substr(san, 3) ELSE lower(rtrim(san, '.')) = {0} END"""
SQL["C3_certificate_validity"] = f"""WITH {CERTS}, f AS (SELECT *, {AS_OF_EPOCH} > valid_until_epoch AS expired, {AS_OF_EPOCH} < valid_from_epoch AS not_yet_valid,
  CAST(floor((valid_until_epoch - {AS_OF_EPOCH}) / 86400.0) AS INT) AS days_remaining, subject = issuer AS self_signed, sig_hash = 'sha1' AS weak_signature, key_algorithm = 'RSA' AND key_bits < 2048 AS weak_key,
  {MATCH.format("'mail.lab.test'")} AS hostname_match FROM certs)
  SELECT fingerprint, expired, not_yet_valid, days_remaining, self_signed, weak_signature, weak_key, hostname_match, CASE WHEN expired THEN 'EXPIRED' WHEN not_yet_valid THEN 'NOT_YET_VALID' WHEN NOT hostname_match THEN 'HOSTNAME_MISMATCH'
  WHEN weak_key THEN 'WEAK_KEY' WHEN weak_signature THEN 'WEAK_SIGNATURE' WHEN self_signed THEN 'SELF_SIGNED' ELSE 'VALID' END AS status FROM f"""
SQL["C4_hostname_match"] = f"WITH {CERTS} SELECT fingerprint, " + ", ".join(MATCH.format(q(n)) + f" AS m{i}" for i, n in enumerate(("mail.lab.test", "lab.test", "a.mail.lab.test", "legacy.mail.test"))) + ", FALSE AS m4, CAST(NULL AS BOOLEAN) AS without_name FROM certs"
SQL["C5_certificate_candidates"] = f"{TO_PACKETS} SELECT frame AS packet_no, CAST(0 AS INT) AS pos, sha256(repeat(leaf_text, 8)) AS fingerprint FROM packets WHERE n_certs >= 1 UNION ALL SELECT frame, 1, sha256(repeat(issuer_text, 8)) FROM packets WHERE n_certs = 2"
SQL["C6_attach_certificate"] = f"{TO_SESSIONS} SELECT capture, session_id, cert_present, cert_subject, CAST(cert_key_bits AS INT) AS cert_key_bits, cert_expired, cert_match AS cert_hostname_match, chain_status AS cert_chain_status, chain_length AS cert_chain_length, cert_status FROM st"
SQL["C7_chain_status"] = f"""{TO_PACKETS}, {CERTS}, sent AS (SELECT p.stream_id, c.pos, c.subject, c.issuer FROM packets p JOIN certs c ON c.stream_id = p.stream_id AND c.pos < p.n_certs
    WHERE p.n_certs > 0 AND (c.pos = 1 OR NOT starts_with(p.leaf_text, '0bad'))),
  n AS (SELECT a.stream_id, count(*) AS k, bool_or(a.subject = a.issuer) FILTER (a.pos = (SELECT max(pos) FROM sent z WHERE z.stream_id = a.stream_id)) AS rooted FROM sent a GROUP BY a.stream_id),
  l AS (SELECT a.stream_id, bool_and(a.issuer = b.subject) AS linked FROM sent a JOIN sent b ON a.stream_id = b.stream_id AND b.pos = a.pos + 1 GROUP BY a.stream_id)
  SELECT CAST(n.stream_id AS VARCHAR) AS stream_id, CAST(k AS INT) AS chain_length, CASE WHEN k = 1 THEN CASE WHEN rooted THEN 'SELF_SIGNED' ELSE 'INCOMPLETE' END WHEN NOT linked THEN 'INCOMPLETE' WHEN rooted THEN 'COMPLETE' ELSE 'COMPLETE_UNVERIFIED_ROOT' END AS chain_status,
  CASE WHEN k = 1 THEN rooted ELSE linked END AS chain_complete FROM n LEFT JOIN l USING (stream_id)"""

# ------------------------------------------------------------------ R
SQL["R0_assess_sessions"] = f"{TO_FINDINGS} SELECT capture, session_id, code, severity, score_impact, confidence, title FROM fnd"
for _i, _rule in enumerate(RULES, 1):
    SQL[f"R{_i}_{_rule[0].lower()}"] = f"{TO_FINDINGS} SELECT capture, session_id, severity, score_impact, evidence FROM fnd WHERE code = {q(_rule[0])}"

# ------------------------------------------------------------------ G
SQL["G1_evidence_completeness"] = scored("SELECT capture, session_id, evidence_completeness FROM sc")
SQL["G2_policy_score"] = scored("SELECT capture, session_id, policy_risk_score, posture_score FROM sc")
SQL["G3_risk_class"] = scored("SELECT capture, session_id, policy_risk_class FROM sc")
SQL["G4_risk_band"] = f"SELECT event_id, {BAND.format('floor(value)')} AS band FROM events"
SQL["G5_flatten_findings"] = f"{TO_FINDINGS} SELECT capture, session_id, CAST(row_number() OVER (PARTITION BY capture, session_id ORDER BY pos) - 1 AS INT) AS emitted, code, {ORDER_OF.format('severity')} AS severity_rank, score_impact FROM fnd"
SQL["G6_capture_summary"] = scored(f""", {SUMMARY.lstrip()} SELECT capture, total_sessions, tls_sessions, plaintext_sessions, starttls_sessions, successful_upgrades, anomalous_sessions, total_findings, severity_info, severity_low,
  severity_medium, severity_high, severity_critical, overall_risk_score, overall_posture_score, overall_risk_class, evidence_completeness, {counter('protocol', '=', ';')} AS protocols, {counter('tls_version', '=', ';')} AS tls_versions,
  {counter('cipher_suite', '=', ';')} AS ciphers FROM smy JOIN sev USING (capture)""")
SQL["G7_top_findings"] = scored(f", {SUMMARY.lstrip()} SELECT capture, CAST(rank AS INT) AS rank, code, severity, title, score_impact FROM top WHERE rank <= 5")
SQL["G8_recommendations"] = f"""{TO_FINDINGS}, base(pos, advice) AS (VALUES {', '.join(f'({i}, {q(t)})' for i, t in enumerate(BASELINE_ADVICE))}),
  seen AS (SELECT capture, advice, 0 AS part, first_frame, session_id, pos FROM fnd UNION ALL SELECT c.capture, b.advice, 1, 0, '', b.pos FROM (SELECT DISTINCT capture FROM st) c CROSS JOIN base b),
  f AS (SELECT *, row_number() OVER (PARTITION BY capture, advice ORDER BY part, first_frame, session_id, pos) AS k FROM seen)
  SELECT capture, CAST(row_number() OVER (PARTITION BY capture ORDER BY part, first_frame, session_id, pos) AS INT) AS position, advice FROM f WHERE k = 1"""
SQL["G9_batch_record"] = scored(f", {SUMMARY.lstrip()} SELECT capture, total_sessions, total_findings, overall_risk_score, ml_matches_rules, (SELECT string_agg(code, ';' ORDER BY rank) FROM top WHERE top.capture = smy.capture AND rank <= 5) AS top_codes FROM smy")
SQL["G10_ml_rule_agreement"] = scored("SELECT capture, count(*) FILTER (ml_class = policy_risk_class) AS ml_matches_rules, count(*) AS sessions FROM sc GROUP BY capture")
SQL["G11_feature_table_stats"] = scored("""SELECT 'total' AS kind, 'rows' AS name, count(*) AS n FROM sc UNION ALL SELECT 'total', 'captures', count(DISTINCT capture) FROM sc
  UNION ALL SELECT 'total', 'agreed', count(*) FROM sc WHERE ml_class = policy_risk_class UNION ALL SELECT 'rule_label', policy_risk_class, count(*) FROM sc GROUP BY 2
  UNION ALL SELECT 'ml_label', ml_class, count(*) FROM sc GROUP BY 2 UNION ALL (SELECT 'finding', code, count(*) AS n FROM fnd GROUP BY 2 ORDER BY n DESC, code LIMIT 15)""")
SQL["G12_run_totals"] = scored(f", {SUMMARY.lstrip()} SELECT capture, total_sessions AS sessions, CAST(1 AS BIGINT) AS captures, overall_risk_class AS risk_class FROM smy UNION ALL SELECT '*', CAST(sum(total_sessions) AS BIGINT), count(*), NULL FROM smy")
SQL["G13_capture_check"] = scored("""SELECT capture, count(*) AS sessions, CAST(sum(n_findings) AS BIGINT) AS findings, first(session_id ORDER BY policy_risk_score DESC, first_frame) AS worst_session,
  max(policy_risk_score) AS worst_score, first(policy_risk_class ORDER BY policy_risk_score DESC, first_frame) AS worst_class, CAST(round_even(avg(posture_score), 0) AS INT) AS posture,
  count(*) FILTER (ml_class = policy_risk_class) AS agree FROM sc GROUP BY capture""")

# ------------------------------------------------------------------ M
SQL["M1_feature_risk_label"] = scored("SELECT capture, session_id, label_score, ml_class AS feature_label FROM sc")
CAPNO = "CAST(substr(capture, 5) AS INT)"
TRAIN = f"train AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY first_frame, session_id) AS k FROM sc WHERE {CAPNO} % 4 <> 3), rep AS (SELECT train.*, c AS copy_no FROM train CROSS JOIN (VALUES (1), (2)) r(c) WHERE k <= 300)"
SQL["M2_training_rows"] = scored(f", {TRAIN} SELECT capture, session_id, copy_no FROM rep")
SQL["M3_stratified_split"] = scored("""SELECT capture, session_id, policy_risk_class, row_number() OVER (PARTITION BY policy_risk_class ORDER BY md5(capture || '|' || session_id || '|42'))
  <= ceil(count(*) OVER (PARTITION BY policy_risk_class) * CAST(0.8 AS DOUBLE)) AS is_train FROM sc""")
SQL["M4_class_weights"] = scored(f", {TRAIN}, c AS (SELECT policy_risk_class AS label, count(*) AS n FROM rep GROUP BY 1) SELECT label, round_even(CAST((SELECT sum(n) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * n), 9) AS weight FROM c")
SQL["M8_rule_fallback"] = scored(f"SELECT capture, session_id, CASE WHEN server_port <> 25 THEN ml_class ELSE policy_risk_class END AS ml_class, CASE WHEN server_port <> 25 THEN 'synthetic-v2' ELSE 'rule-fallback (synthetic-v2)' END AS ml_version, CASE WHEN server_port = 25 THEN {q(FALLBACK_NOTE + ' ML prediction fallback: no prediction')} END AS ml_note FROM sc")
SQL["M9_explanations"] = scored("""SELECT sc.capture, sc.session_id, coalesce(t.titles, '') AS titles FROM sc LEFT JOIN (SELECT capture, session_id, string_agg(title, ';' ORDER BY pos) AS titles FROM
  (SELECT *, row_number() OVER (PARTITION BY capture, session_id ORDER BY pos) AS k FROM fnd WHERE severity NOT IN ('INFO', 'LOW')) x WHERE k <= 5 GROUP BY ALL) t USING (capture, session_id)""")
SQL["M10_confusion"] = scored("SELECT policy_risk_class, " + ", ".join(f'count(*) FILTER (ml_class = {q(c)}) AS "{c}"' for c in ("CRITICAL", "HIGH", "LOW", "MEDIUM")) + " FROM sc GROUP BY policy_risk_class")
SQL["M10_agreement"] = scored("SELECT capture, count(*) AS rows, count(*) FILTER (ml_class = policy_risk_class) AS correct, round_even(CAST(count(*) FILTER (ml_class = policy_risk_class) AS DOUBLE) / count(*), 4) AS accuracy FROM sc GROUP BY capture")
def forest_rows(select: str, train: str, folds: bool, trees: int, score: str | None = None) -> str:
    head = TO_SCORED.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"{head}, {TRAIN}, {forest(train, FEATURE_SQL, trees, folds, score)} {select}"


VOTED = f"""SELECT * EXCLUDE (label), ['CRITICAL', 'HIGH', 'LOW', 'MEDIUM'][label + 1] AS label, CASE greatest(v0, v1, v2, v3) WHEN v0 THEN 'CRITICAL' WHEN v1 THEN 'HIGH' WHEN v2 THEN 'LOW' ELSE 'MEDIUM' END AS ml_class,
  greatest(v0, v1, v2, v3) AS best FROM (SELECT fold AS capture, session_id, label, sum(v0) AS v0, sum(v1) AS v1, sum(v2) AS v2, sum(v3) AS v3 FROM grown WHERE tag = 'vote' GROUP BY ALL) x"""
AGREED = f"SELECT replace(capture, 'scored|', '') AS capture, count(*) AS rows, count(*) FILTER (ml_class = label) AS correct, round_even(CAST(count(*) FILTER (ml_class = label) AS DOUBLE) / count(*), 4) AS accuracy FROM ({VOTED}) y GROUP BY capture"
LABELLED = "SELECT sc.*, 1 AS copy_no, policy_risk_class AS label FROM sc"
REPEATED = "SELECT *, policy_risk_class AS label FROM rep"
SQL["M4_fit_risk"] = forest_rows("""SELECT tree, count(*) FILTER (kind = 'split') AS splits, count(*) FILTER (kind = 'leaf') AS leaves, max(depth) AS depth, CAST(sum(n_rows) FILTER (kind = 'leaf') AS BIGINT) AS rows,
  CAST(sum(v0) AS BIGINT) AS critical_votes FROM grown WHERE tag = 'out' GROUP BY tree""", REPEATED, False, 220)
SQL["M5_score_risk"] = forest_rows(f"SELECT replace(capture, 'scored|', '') AS capture, session_id, ml_class, round_even(CAST(best * 100 AS DOUBLE) / (220 * 1000000), 2) AS ml_confidence FROM ({VOTED}) y",
                                   REPEATED, False, 220, LABELLED)
SQL["M11_leave_one_capture_out"] = forest_rows(AGREED, REPEATED, True, 120)
SQL["M11_held_out_forests"] = forest_rows("SELECT fold AS capture, count(DISTINCT tree) AS trees, count(*) FILTER (kind = 'leaf') AS leaves, CAST(sum(n_rows) FILTER (kind = 'leaf') AS BIGINT) AS rows FROM grown WHERE tag = 'out' GROUP BY fold",
                                          REPEATED, True, 120)
SQL["M12_transfer_test"] = forest_rows(AGREED, f"{LABELLED} WHERE {CAPNO} % 2 = 1", False, 220, f"{LABELLED} WHERE {CAPNO} % 2 = 0")
LONG = "feat AS (SELECT capture, session_id, server_port, first_frame, feature, value FROM (" + " UNION ALL ".join(
    f"SELECT capture, session_id, server_port, first_frame, {q(n)} AS feature, CAST({FEATURE_SQL[n]} AS DOUBLE) AS value FROM st" for n in FEATURES) + ") x)"
SQL["M13_feature_ranges"] = f"{TO_SESSIONS}, {LONG} SELECT feature, round_even(min(value), 6) AS min, round_even(quantile_cont(value, 0.01), 6) AS p01, round_even(quantile_cont(value, 0.5), 6) AS p50, round_even(quantile_cont(value, 0.99), 6) AS p99, round_even(max(value), 6) AS max FROM feat GROUP BY feature"
POSITION = "CASE feature " + " ".join(f"WHEN {q(n)} THEN {i}" for i, n in enumerate(FEATURES)) + " END"
NOVEL = f"""{LONG}, bounds AS (SELECT feature, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM feat WHERE server_port IN (25, 465, 587) GROUP BY feature),
  nov AS (SELECT capture, session_id, coalesce(string_agg(feature, ';' ORDER BY {POSITION}) FILTER (value < lo OR value > hi), '') AS outside, count(*) FILTER (value < lo OR value > hi) AS n FROM feat JOIN bounds USING (feature) GROUP BY capture, session_id)"""
SQL["M14_novelty_session"] = f"""{TO_SESSIONS}, {NOVEL} SELECT capture, session_id, outside, n >= 2 AS novel, CASE WHEN n >= 2 THEN 'OUTSIDE TRAINING RANGE' ELSE 'within training range' END AS novelty_verdict,
  CASE WHEN n = 0 THEN {q(ALL_INSIDE)} WHEN n >= 2 THEN n || ' of {len(FEATURES)} features are outside the training range: ' || listed || '. The ML class is not validated for this session - rely on the rule findings.'
  ELSE 'Features slightly outside the training range: ' || listed || '.' END AS novelty_note
  FROM (SELECT *, array_to_string(string_split(outside, ';')[1:6], ', ') || CASE WHEN n > 6 THEN ' (+' || (n - 6) || ' more)' ELSE '' END AS listed FROM nov) x"""
SQL["M15_novelty_capture"] = f"""{TO_SESSIONS}, {NOVEL}, o AS (SELECT capture, string_agg(feature, ';' ORDER BY ff, sid, {POSITION}) AS outside_features, count(*) AS k FROM (SELECT capture, feature, min(first_frame) AS ff, first(session_id ORDER BY first_frame, session_id) AS sid FROM feat JOIN bounds USING (feature) WHERE value < lo OR value > hi GROUP BY capture, feature) x GROUP BY capture),
  t AS (SELECT capture, count(*) AS sessions, count(*) FILTER (n >= 2) AS novel_sessions FROM nov GROUP BY capture)
  SELECT capture, sessions, novel_sessions, coalesce(outside_features, '') AS outside_features, CASE WHEN coalesce(k, 0) >= 2 THEN 'OUTSIDE TRAINING RANGE' ELSE 'within training range' END AS verdict,
  CASE WHEN novel_sessions > 0 THEN novel_sessions || ' of ' || sessions || ' session(s) fall outside the training range. The rule findings still apply; treat the ML class as unvalidated here.'
    ELSE 'All ' || sessions || ' session(s) are within the range the model was trained on.' END AS note FROM t LEFT JOIN o USING (capture)"""
SQL["M16_model_freshness"] = f"WITH {FILES} SELECT max(length) + 1700000000 AS newest, CAST(1700000900 AS BIGINT) AS model_epoch, coalesce(max(length) + 1700000000 <= 1700000901, TRUE) AS fresh FROM files WHERE regexp_matches(path, '/(samples|samples/lab|samples/sweep)/[^/]+\\.(pcap|pcapng|cap)$')"

# ------------------------------------------------------------------ E
DECLARED = """decl AS (SELECT capture, stream_id, CASE WHEN stream_id % 5 = 0 THEN 'large' ELSE 'singles' END AS grp, max(spoken) AS protocol, max(scenario) AS s, bool_or(implicit) AS imp,
    min(CASE WHEN src_port < 30000 THEN src_port ELSE dst_port END) AS server_port, min(CASE WHEN src_port >= 30000 THEN src_port ELSE dst_port END) AS client_port,
    CASE WHEN stream_id % 50 = 7 THEN 2 ELSE 1 END AS rounds, stream_id % 4 <> 0 AS unseen FROM packets GROUP BY capture, stream_id),
modes AS (SELECT *, CASE WHEN imp THEN 'implicit_tls' WHEN s < 4 THEN CASE protocol WHEN 'SMTP' THEN 'smtp_secure' WHEN 'IMAP' THEN 'imap_starttls' ELSE 'pop3_stls' END
    WHEN s = 4 THEN CASE protocol WHEN 'SMTP' THEN 'smtp_reject_starttls' WHEN 'IMAP' THEN 'imap_reject_starttls' ELSE 'pop3_reject_stls' END
    ELSE CASE protocol WHEN 'SMTP' THEN 'smtp_no_starttls' WHEN 'IMAP' THEN 'imap_cleartext_login' ELSE 'pop3_cleartext' END END AS mode,
    CASE WHEN s = 1 THEN 'legacy-tls10' WHEN s = 2 THEN 'cbc-only' WHEN s = 3 THEN 'modern-tls13' WHEN s = 4 AND imp THEN 'null-cipher' WHEN s = 5 AND imp THEN 'static-rsa'
    WHEN imp OR s < 4 THEN CASE WHEN stream_id % 6 = 1 THEN 'weak-cert' ELSE 'modern' END END AS profile FROM decl)"""
PROFILE_TABLE = "profiles(profile, pv, pfs, pcert, pexp, pforb) AS (VALUES " + ", ".join(
    f"({q(n)}, {q(v)}, {q(f)}::BOOLEAN, {q(c)}, {q(e)}, {q(x)})" for n, (v, f, c, e, x) in PROFILES.items()) + ")"
EXPECTED = f"""{PROFILE_TABLE}, {DECLARED},
exp AS (SELECT m.* EXCLUDE (profile), m.profile, pv, pfs, coalesce(pcert, FALSE) AS pcert, mode IN {one_of(CLEARTEXT_MODES)} AS clear,
    list_concat(CASE WHEN mode IN {one_of(REJECTED_MODES)} THEN ['STARTTLS_REJECTED'] ELSE []::VARCHAR[] END, CASE WHEN mode IN {one_of(CLEARTEXT_MODES)} THEN ['PLAINTEXT_AUTHENTICATION'] ELSE []::VARCHAR[] END, coalesce(pexp, []::VARCHAR[])) AS want,
    list_concat(CASE WHEN mode = 'implicit_tls' THEN {q(IMPLICIT_FORBIDDEN)} WHEN mode IN {one_of(UPGRADE_MODES)} THEN {q(UPGRADE_FORBIDDEN)} ELSE {q(CLEARTEXT_FORBIDDEN)} END, coalesce(pforb, []::VARCHAR[])) AS ban,
    CASE WHEN mode IN {one_of(CLEARTEXT_MODES)} THEN 'CRITICAL' WHEN m.profile IN ('modern', 'modern-tls13') THEN 'LOW' END AS exact,
    CASE WHEN mode IN {one_of(CLEARTEXT_MODES)} OR m.profile IN ('modern', 'modern-tls13') OR m.profile IS NULL THEN NULL WHEN m.profile IN ('legacy-tls10', 'weak-cert', 'null-cipher') THEN ['HIGH', 'CRITICAL'] ELSE ['MEDIUM', 'HIGH'] END AS band
    FROM modes m LEFT JOIN profiles p ON p.profile = m.profile)"""
MATCHED = f"""{EXPECTED},
rnd AS (SELECT exp.*, unnest(range(1, rounds + 1)) AS round FROM exp),
em AS (SELECT rnd.*, row_number() OVER (PARTITION BY capture, protocol, server_port, client_port ORDER BY stream_id, mode, coalesce(profile, ''), round) AS k FROM rnd),
am AS (SELECT *, row_number() OVER (PARTITION BY capture, protocol, server_port, client_port ORDER BY first_frame, session_id) AS k FROM sc),
mt AS (SELECT em.capture, em.grp, em.protocol, em.server_port, em.client_port, em.mode, em.profile, em.round, em.k, em.unseen, em.want, em.ban, em.exact, em.band, em.pv, em.pfs, em.pcert, am.session_id, am.session_id IS NOT NULL AS ok_matched,
    am.code_list, am.codes, am.tls_version, am.tls_detected, am.forward_secrecy AS fs, am.cert_present, am.policy_risk_class AS pc, am.ml_class AS mc, am.cipher_suite
    FROM em LEFT JOIN am ON am.capture = em.capture AND am.protocol = em.protocol AND am.server_port = em.server_port AND am.client_port = em.client_port AND am.k = em.k),
ck AS (SELECT mt.*, coalesce(array_to_string(list_sort(list_filter(list_distinct(want), lambda c: NOT list_contains(code_list, c))), ';'), '') AS missing,
    coalesce(array_to_string(list_sort(list_filter(list_distinct(ban), lambda c: list_contains(code_list, c))), ';'), '') AS violations,
    (CASE WHEN tls_detected THEN tls_version END) IS NOT DISTINCT FROM pv AS version_ok, cert_present = pcert AS cert_ok,
    pfs IS NULL OR (CASE WHEN tls_detected THEN fs END) IS NOT DISTINCT FROM pfs AS secrecy_ok,
    CASE WHEN exact IS NOT NULL THEN pc = exact WHEN band IS NOT NULL THEN list_contains(band, pc) ELSE TRUE END AS class_ok FROM mt),
res AS (SELECT ck.*, ok_matched AND missing = '' AS ok_findings, ok_matched AND violations = '' AS ok_forbidden, ok_matched AND version_ok AND cert_ok AND secrecy_ok AS ok_facts,
    ok_matched AND class_ok AS ok_class, CASE WHEN ok_matched THEN mc = pc END AS ml_agrees FROM ck)"""
TO_MATCHED = f"{TO_SCORED}, {MATCHED}"
SITUATION = "capture, protocol, server_port, client_port, mode, profile, CAST(round AS INT) AS round"
SQL["E1_match_expected"] = f"{TO_MATCHED} SELECT {SITUATION}, session_id FROM res"
SQL["E2_check_findings"] = f"{TO_MATCHED} SELECT {SITUATION}, missing, violations FROM res WHERE ok_matched"
SQL["E3_check_facts"] = f"{TO_MATCHED} SELECT {SITUATION}, version_ok, cert_ok, secrecy_ok FROM res WHERE ok_matched"
SQL["E4_check_class"] = f"{TO_MATCHED} SELECT {SITUATION}, class_ok FROM res WHERE ok_matched"
CHECK_COUNTS = "count(*) AS sessions, count(*) FILTER (ok_matched) AS matched, count(*) FILTER (ok_findings) AS findings, count(*) FILTER (ok_forbidden) AS forbidden, count(*) FILTER (ok_facts) AS facts, count(*) FILTER (ok_class) AS class"
SUMMARY_COLUMNS = f"{CHECK_COUNTS}, count(*) FILTER (ml_agrees) AS ml_agree, count(ml_agrees) AS ml_compared, count(DISTINCT (protocol, server_port, mode, profile)) AS situations FROM res"
SQL["E5_score_summary"] = f"{TO_MATCHED} SELECT 'all' AS subset, {SUMMARY_COLUMNS} UNION ALL SELECT 'unseen', {SUMMARY_COLUMNS} WHERE unseen UNION ALL SELECT 'scale', {SUMMARY_COLUMNS} WHERE grp = 'large' UNION ALL SELECT 'distinct', {SUMMARY_COLUMNS} WHERE grp <> 'large'"
SQL["E6_per_capture_checks"] = f'{TO_MATCHED} SELECT capture, grp AS "group", {CHECK_COUNTS} FROM res GROUP BY capture, grp'
SQL["E7_observed_per_situation"] = f"""{TO_MATCHED} SELECT protocol, server_port, mode, profile, count(*) AS seen, first(pc ORDER BY capture, k, client_port) AS rules_class, first(replace(codes, '|', ', ') ORDER BY capture, k, client_port) AS findings
  FROM res WHERE grp <> 'large' AND ok_matched GROUP BY protocol, server_port, mode, profile"""
SQL["E8_ml_disagreements"] = f"{TO_MATCHED} SELECT protocol, server_port, mode, profile, pc AS rules_class, mc AS ml_class, count(*) AS sessions FROM res WHERE NOT ml_agrees GROUP BY ALL"
SQL["E9_failed_expectations"] = f"""{TO_MATCHED} SELECT {SITUATION}, concat_ws(', ', CASE WHEN NOT ok_matched THEN 'matched' END, CASE WHEN NOT ok_findings THEN 'findings' END, CASE WHEN NOT ok_forbidden THEN 'forbidden' END,
  CASE WHEN NOT ok_facts THEN 'facts' END, CASE WHEN NOT ok_class THEN 'class' END) AS failed,
  CASE WHEN NOT ok_matched THEN 'no session matched these addresses in the capture' ELSE concat_ws('; ', CASE WHEN missing <> '' THEN 'missing findings: ' || replace(missing, ';', ', ') END,
    CASE WHEN violations <> '' THEN 'invented findings: ' || replace(violations, ';', ', ') END, CASE WHEN NOT version_ok THEN 'tls_version: expected ' || coalesce(pv, 'None') || ', got ' || coalesce(tls_version, 'None') END,
    CASE WHEN NOT class_ok THEN 'class: expected ' || coalesce(exact, array_to_string(band, '/')) || ', got ' || pc END) END AS detail
  FROM res WHERE NOT (ok_matched AND ok_findings AND ok_forbidden AND ok_facts AND ok_class)"""
SCENARIOS = f"""scn(scenario, want, ban) AS (VALUES ('imaps-cbc', ['LEGACY_CBC_CIPHER'], ['TLS_VERSION_UNKNOWN']), ('smtp-clear', ['PLAINTEXT_AUTHENTICATION', 'TLS_VERSION_UNKNOWN'], []::VARCHAR[]), ('pop3-modern', []::VARCHAR[], ['INSECURE_CIPHER'])),
  caps AS (SELECT DISTINCT capture, ['imaps-cbc','smtp-clear','pop3-modern','mixed'][{CAPNO} % 4 + 1] AS scenario, CASE WHEN {CAPNO} % 3 = 0 THEN 9000 + {CAPNO} END AS port FROM packets),
  obs AS (SELECT capture, list(DISTINCT code) AS seen FROM fnd GROUP BY capture),
  worst AS (SELECT capture, count(*) AS sessions, first(policy_risk_class ORDER BY policy_risk_score DESC, first_frame) AS rules_class, first(posture_score ORDER BY policy_risk_score DESC, first_frame) AS posture, count(*) FILTER (ml_class = policy_risk_class) AS agree FROM sc GROUP BY capture),
  out AS (SELECT caps.*, sessions, rules_class, posture, agree, coalesce(array_to_string(list_sort(list_filter(want, lambda c: NOT list_contains(seen, c))), ';'), '') AS missing, coalesce(array_to_string(list_sort(list_filter(ban, lambda c: list_contains(seen, c))), ';'), '') AS forbidden_seen
    FROM caps LEFT JOIN scn USING (scenario) JOIN worst USING (capture) JOIN obs USING (capture))"""
SQL["E10_capability_verdict"] = scored(f", {SCENARIOS} SELECT capture, scenario, port, sessions, rules_class, agree, missing, forbidden_seen, CASE WHEN missing = '' AND forbidden_seen = '' THEN 'PASS' ELSE 'FAIL' END AS verdict FROM out")
SQL["E11_finding_coverage"] = f"{TO_FINDINGS} SELECT code, count(DISTINCT capture) AS captures FROM fnd GROUP BY code"
SQL["E12_scenario_verify"] = scored(f", {SCENARIOS} SELECT capture, scenario, sessions, missing, rules_class AS worst_class, posture, CASE WHEN missing = '' AND forbidden_seen = '' THEN 'OK' ELSE 'CHECK' END AS status FROM out")
# list_distinct does not keep order, so repeated entries are dropped by their first place.
KEEP_FIRST = "array_to_string(list_filter({0}, lambda x, i: list_position({0}, x) = i), ';')"
SQL["E13_declare_expectation"] = f"""{TO_PACKETS}, {EXPECTED} SELECT protocol, server_port, mode, profile, {KEEP_FIRST.format('want')} AS expect, {KEEP_FIRST.format('ban')} AS forbid,
  exact AS class_exact, array_to_string(band, ';') AS band, pv AS tls_version, pcert AS cert_observed, pfs AS forward_secrecy, count(*) AS n FROM exp GROUP BY ALL"""
SQL["E14_coverage_matrix"] = f"""{TO_PACKETS}, {PROFILE_TABLE}, {DECLARED}, ports(protocol, port) AS (VALUES {', '.join(f'({q(p)}, {n})' for p, pair in SWEEP_PORTS.items() for n in pair)})
  SELECT lower(ports.protocol) || '-' || profiles.profile || '-port' || port AS name, port, profiles.profile, array_to_string(pexp, ';') AS expect, array_to_string(pforb, ';') AS forbid,
  (SELECT count(*) FROM modes m WHERE m.server_port = port AND m.profile = profiles.profile) AS observed FROM ports CROSS JOIN profiles"""
SQL["E15_heldout_leak_check"] = f"{TO_PACKETS} SELECT 'leaks' AS name, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'undeclared', 0 UNION ALL SELECT 'training', count(DISTINCT capture) FROM packets WHERE {CAPNO} % 4 <> 3"
SQL["E16_replicate_shift"] = f"{TO_PACKETS} SELECT frame AS packet_no, CAST(c AS INT) AS copy_no, stream_id || '-' || c AS stream_id, ts_us + c * 900000000 AS ts_us FROM packets CROSS JOIN (VALUES (0), (1), (2)) r(c)"

# ------------------------------------------------------------------ Q
SQL["Q1_list_analyses"] = f"WITH {ANALYSES} SELECT analysis_id, source_filename, created_at, analyzer_version, size_bytes FROM analyses"
SQL["Q2_get_session"] = scored("SELECT capture, session_id, policy_risk_score FROM sc WHERE capture = 'cap-3' AND session_id = 'tcp.stream.3001'")
SQL["Q3_current_version_only"] = f"WITH {ANALYSES} SELECT analysis_id, created_at FROM analyses WHERE analyzer_version = '3.2.0'"
SQL["Q4_newest_per_capture"] = f"WITH {ANALYSES} SELECT source_filename, analysis_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY source_filename ORDER BY created_at DESC, analysis_id DESC) AS k FROM analyses WHERE analyzer_version = '3.2.0') x WHERE k = 1 AND source_filename LIKE '%src1%'"
SQL["Q5_retention"] = f"""WITH {ANALYSES} SELECT count(*) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, analysis_id DESC) AS k FROM analyses) x WHERE k > 20
  UNION ALL SELECT count(*), CAST(sum(size_bytes) AS BIGINT) FROM analyses WHERE analyzer_version <> '3.2.0'"""
SQL["Q6_ranked_sessions"] = scored("SELECT capture, session_id, policy_risk_score, (SELECT count(*) FROM sc) AS total, greatest((SELECT count(*) FROM sc) - 200, 0) AS not_shown FROM sc ORDER BY policy_risk_score DESC, capture, first_frame, session_id LIMIT 200")
SQL["Q7_top_findings_report"] = f"{TO_FINDINGS} SELECT capture, session_id, code, (SELECT count(*) FROM fnd) AS total FROM fnd ORDER BY {ORDER_OF.format('severity')} DESC, score_impact DESC, title, capture, first_frame, session_id, pos LIMIT 40"
DESCRIBED = "said(code, words) AS (VALUES " + ", ".join(f"({q(r[0])}, {q(r[5] + ' ' + r[6])})" for r in RULES) + ")"
SQL["Q8_search"] = scored(f""", {DESCRIBED} SELECT capture, session_id, code FROM fnd JOIN said USING (code) WHERE contains(lower(concat_ws(' ', code, title, session_id, severity, evidence, words)), 'starttls')
  UNION ALL SELECT capture, session_id, '(session)' FROM sc WHERE contains(lower(concat_ws(' ', session_id, protocol, server_port, tls_version, cipher_suite, policy_risk_class, ml_class)), 'gcm')""")
SQL["Q9_severity_distribution"] = f"""{TO_FINDINGS}, dim(severity, position) AS (VALUES {', '.join(f'({q(s)}, {len(SEVERITIES) - i})' for i, s in enumerate(SEVERITIES))}),
  c AS (SELECT dim.severity, position, count(fnd.code) AS n FROM dim LEFT JOIN fnd USING (severity) GROUP BY ALL)
  SELECT severity, position, n, CAST(round_even(CAST(n AS DOUBLE) / (SELECT max(n) FROM c) * 100, 0) AS INT) AS width FROM c"""
SQL["Q10_capture_facts"] = scored(f""", {SUMMARY.lstrip()} SELECT capture, {counter('protocol', ' x', ', ')} AS protocols, {counter('tls_version', ' x', ', ')} AS tls_versions, {counter('cipher_suite', ' x', ', ')} AS ciphers,
  CASE WHEN plaintext_sessions > 0 THEN plaintext_sessions || ' of ' || total_sessions || ' sessions carry mail without encryption.' ELSE '' END AS plaintext_note FROM smy""")
LABEL = "CASE WHEN implicit_tls THEN 'implicit TLS' WHEN starttls_rejected THEN 'REJECTED' WHEN upgrade_successful THEN 'upgraded' WHEN starttls_command THEN 'requested, unconfirmed' WHEN starttls_advertised THEN 'advertised only' ELSE '-' END"
SQL["Q11_upgrade_label"] = f"{TO_SESSIONS} SELECT capture, session_id, CASE WHEN upgrade_successful THEN 'upgraded' WHEN starttls_rejected THEN 'rejected' WHEN tls_detected THEN '-' ELSE 'cleartext' END AS label, {LABEL} AS manifest_label FROM st"
SQL["Q12_sample_manifest"] = scored(f"""SELECT capture, string_agg(DISTINCT protocol, '/' ORDER BY protocol) AS protocols, count(*) AS sessions, count(*) FILTER (tls_detected) AS tls, CAST(sum(n_findings) AS BIGINT) AS findings,
  ['LOW','MEDIUM','HIGH','CRITICAL'][max({ORDER_OF.format('policy_risk_class')})] AS worst_class, count(*) FILTER (ml_class = policy_risk_class) || '/' || count(*) AS agreement FROM sc GROUP BY capture""")
SQL["Q12_manifest_sessions"] = scored(f"""SELECT capture, CAST(k AS INT) AS position, session_id, protocol || ':' || server_port AS service, {LABEL} AS upgrade,
  CASE WHEN tls_version IS NOT NULL THEN tls_version || ' (' || version_source || ')' WHEN tls_detected THEN 'UNKNOWN (' || version_source || ')' ELSE '-' END AS version,
  coalesce(cipher_suite, CASE WHEN cipher_source = 'CLIENT_OFFER' THEN 'UNKNOWN (client offer only)' END, '-') AS cipher,
  CASE WHEN NOT tls_detected THEN 'session without TLS' WHEN plaintext_auth THEN 'YES' ELSE 'no' END AS cleartext, greatest(n - 8, 0) AS more
  FROM (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY first_frame, session_id) AS k, count(*) OVER (PARTITION BY capture) AS n FROM sc) x WHERE k <= 8""")
SQL["Q13_ml_disagreement_flag"] = scored("SELECT capture, session_id, policy_risk_class, ml_class, policy_risk_class <> ml_class AS disagrees FROM sc")
