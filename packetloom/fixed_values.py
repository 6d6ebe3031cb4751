"""Names, tables, patterns and constants that results depend on.

Everything here must equal the published taxonomy or format it stands for; no logic.
"""

# Kill-chain stages by id.
STAGES = {
    0: "Benign",
    1: "Reconnaissance",
    2: "Initial Access",
    3: "Credential Access",
    4: "Lateral Movement",
    5: "Command & Control",
    6: "Exfiltration",
}

# Dataset label (trimmed, lower case) -> (stage id, technique).
LABELS = {
    "benign": (0, "None"),
    "normal": (0, "None"),
    "background": (0, "None"),
    "portscan": (1, "T1595.001"),
    "reconnaissance": (1, "T1595"),
    "ipsweep": (1, "T1595.002"),
    "nmap": (1, "T1595"),
    "ddos attacks-loic-http": (2, "T1498"),
    "ddos attack-loic-udp": (2, "T1498"),
    "ddos attack-hoic": (2, "T1498"),
    "dos attacks-slowloris": (2, "T1498.001"),
    "dos attacks-slowhttptest": (2, "T1498.001"),
    "dos attacks-hulk": (2, "T1498"),
    "dos attacks-goldeneye": (2, "T1498"),
    "ddos": (2, "T1498"),
    "dos": (2, "T1498"),
    "brute force -web": (2, "T1190"),
    "brute force -xss": (2, "T1190"),
    "sql injection": (2, "T1190"),
    "infilteration": (4, "T1021"),
    "infiltration": (4, "T1021"),
    "ftp-bruteforce": (3, "T1110"),
    "ssh-bruteforce": (3, "T1110"),
    "ftp-patator": (3, "T1110.001"),
    "ssh-patator": (3, "T1110.001"),
    "bot": (5, "T1071.001"),
    "botnet": (5, "T1071.001"),
    "c&c": (5, "T1071"),
    "cc": (5, "T1071"),
    "c&c-torii": (5, "T1071"),
    "c&c-mirai": (5, "T1071"),
    "exfiltration": (6, "T1041"),
    "benigntraffic": (0, "None"),
    "recon-hostdiscovery": (1, "T1595.002"),
    "recon-osscan": (1, "T1595.001"),
    "recon-portscan": (1, "T1595.001"),
    "recon-pingsweep": (1, "T1595.002"),
    "vulnerabilityscan": (1, "T1595.002"),
    "ddos-icmp_flood": (2, "T1498"),
    "ddos-udp_flood": (2, "T1498"),
    "ddos-tcp_flood": (2, "T1498"),
    "ddos-syn_flood": (2, "T1498"),
    "ddos-pshack_flood": (2, "T1498"),
    "ddos-rstfinflood": (2, "T1498"),
    "ddos-synonymousip_flood": (2, "T1498"),
    "ddos-icmp_fragmentation": (2, "T1498"),
    "ddos-ack_fragmentation": (2, "T1498"),
    "ddos-udp_fragmentation": (2, "T1498"),
    "ddos-http_flood": (2, "T1498"),
    "ddos-slowloris": (2, "T1498.001"),
    "dos-udp_flood": (2, "T1498"),
    "dos-tcp_flood": (2, "T1498"),
    "dos-syn_flood": (2, "T1498"),
    "dos-http_flood": (2, "T1498"),
    "sqlinjection": (2, "T1190"),
    "commandinjection": (2, "T1190"),
    "browserhijacking": (2, "T1189"),
    "xss": (2, "T1190"),
    "uploading_attack": (2, "T1190"),
    "dns_spoofing": (2, "T1557"),
    "dictionarybruteforce": (3, "T1110.001"),
    "mitm-arpspoofing": (4, "T1557.002"),
    "mirai-greeth_flood": (5, "T1071.001"),
    "mirai-greip_flood": (5, "T1071.001"),
    "mirai-udpplain": (5, "T1071.001"),
    "backdoor_malware": (5, "T1071"),
    "from_malware": (2, "T1204.002"),
    "malicious": (2, "T1204"),
    "doh": (5, "T1071.001"),
    "dot": (5, "T1071.001"),
    "google": (0, "None"),
    "microsoft": (0, "None"),
    "(empty)": (0, "None"),
    "multicast": (0, "None"),
    "fuzzers": (1, "T1595"),
    "analysis": (1, "T1595.002"),
    "generic": (2, "T1190"),
    "exploits": (2, "T1190"),
    "shellcode": (2, "T1059"),
    "backdoor": (5, "T1071.001"),
    "backdoors": (5, "T1071.001"),
    "worms": (4, "T1021"),
}

# Ordered fallback patterns on the cleaned label -> (stage id, technique); the first match wins.
LABEL_PATTERNS = [
    (r"\b(normal|background)\b", 0, "None"),
    (r"\b(botnet|c&c|-cc\b|neris|rbot|virut|menti|sogou|murlo)\b", 5, "T1071"),
    (r"\b(portscan|nmap|ipsweep|scan)\b", 1, "T1595"),
    (r"\b(bruteforce|patator|password)\b", 3, "T1110"),
    (r"\b(ddos|dos|slowloris|goldeneye|hulk|loic|hoic)\b", 2, "T1498"),
    (r"\b(infilteration|infiltration|lateral)\b", 4, "T1021"),
    (r"\b(exfil|exfiltration)\b", 6, "T1041"),
]

# Cleaned labels that are not reported as unmapped, and labels that reset a row to benign.
QUIET_LABELS = ["benign", "none", "nan", "", "0"]
RESET_LABELS = ["benign", "normal", "background", "nan", "none", "0", ""]

# Telemetry rules: (stage id, technique, confidence).
RULE_EXFIL = (6, "T1041", 0.75)
RULE_C2 = (5, "T1071", 0.85)
RULE_LATERAL = (4, "T1021.002", 0.85)
RULE_CREDENTIAL = (3, "T1110", 0.80)
RULE_INITIAL = (2, "T1190", 0.70)
RULE_RECON = (1, "T1595.001", 0.75)
RULE_NONE = (0, "None", 0.95)
AUTH_PORTS = [21, 22, 23, 3389]
LATERAL_PORTS = [445, 135, 139, 3389, 5985]
C2_PORTS = [8088, 4444, 9001, 1337, 31337]
WEB_PORTS = [80, 443, 8080]
EXFIL_BYTES = 50_000
EXPLOIT_BYTES = 4_000

# Confidences of explicit labels.
CONF_RESET, CONF_LABEL = 0.99, 0.90
# Window labels made from raw labels only: (malicious, benign) confidence.
CONF_RAW_MALICIOUS, CONF_RAW_BENIGN = 0.85, 0.95

# Anticipation target.
TAU_SECONDS = 10.0

# Stage -> (tactic label, tactic code), default Initial Access.
TACTICS = {
    "Lateral Movement": ("Lateral Movement", "TA0008"),
    "Credential Access": ("Credential Access", "TA0006"),
    "Initial Access": ("Initial Access", "TA0001"),
    "Command & Control": ("Command & Control", "TA0011"),
    "Exfiltration": ("Exfiltration", "TA0010"),
    "Reconnaissance": ("Reconnaissance", "TA0043"),
    "Execution": ("Execution", "TA0002"),
    "Impact": ("Impact", "TA0040"),
    "Ingress Tool Transfer": ("Command & Control", "TA0011"),
}
STAGE_TECHNIQUES = {
    0: "None", 1: "T1595", 2: "T1190", 3: "T1110", 4: "T1021", 5: "T1071", 6: "T1041",
}

# Well-known service names.
PORT_NAMES = {
    53: "DNS", 80: "HTTP", 443: "HTTPS", 445: "SMB", 135: "RPC", 139: "NetBIOS", 22: "SSH",
    21: "FTP", 23: "Telnet", 3389: "RDP", 502: "Modbus", 5432: "PostgreSQL", 3306: "MySQL",
    8080: "HTTP-Proxy", 8443: "HTTPS-Alt",
}
# Protocol text -> number.
PROTOCOL_NUMBERS = {"tcp": 6, "udp": 17, "icmp": 1, "arp": 2054, "ospf": 89}
ZEEK_PROTOCOL_NUMBERS = {"tcp": 6, "udp": 17, "icmp": 1}

# Flow CSV headers -> canonical names.
FLOW_HEADERS = {
    "Src IP": "src_ip", "Source IP": "src_ip",
    "Src Port": "src_port", "Source Port": "src_port",
    "Dst IP": "dst_ip", "Destination IP": "dst_ip",
    "Dst Port": "dst_port", "Destination Port": "dst_port",
    "Protocol": "protocol", "Timestamp": "timestamp", "Label": "label",
    "Flow Duration": "flow_duration",
    "Tot Fwd Pkts": "tot_fwd_pkts", "Tot Bwd Pkts": "tot_bwd_pkts",
    "TotLen Fwd Pkts": "tot_len_fwd_pkts", "TotLen Bwd Pkts": "tot_len_bwd_pkts",
    "Flow Byts/s": "flow_byts_s", "Flow Bytes/s": "flow_byts_s",
    "Flow Pkts/s": "flow_pkts_s", "Flow Packets/s": "flow_pkts_s",
    "Flow IAT Mean": "flow_iat_mean", "Flow IAT Std": "flow_iat_std",
    "Flow IAT Max": "flow_iat_max", "Flow IAT Min": "flow_iat_min",
    "SYN Flag Cnt": "syn_flag_cnt", "ACK Flag Cnt": "ack_flag_cnt",
    "FIN Flag Cnt": "fin_flag_cnt", "RST Flag Cnt": "rst_flag_cnt",
    "PSH Flag Cnt": "psh_flag_cnt", "URG Flag Cnt": "urg_flag_cnt",
}

# Channel graph: attack category text -> class.
ATTACK_CATEGORIES = {
    "normal": 0, "fuzzers": 1, "analysis": 2, "backdoor": 3, "backdoors": 3, "dos": 4,
    "exploits": 5, "generic": 6, "reconnaissance": 7, "shellcode": 8, "worms": 9,
}

# Edge feature order; attribution looks at the first twelve.
EDGE_FEATURES = [
    "log_packet_count", "log_byte_volume", "syn_ratio", "ack_ratio", "rst_ratio", "fin_ratio",
    "retransmission_rate", "unique_dst_ports", "mean_ttl", "ttl_std", "mean_tcp_window",
    "is_internal", "iat_mean", "iat_std", "iat_max", "bidi_ratio",
]
NODE_FEATURES = [
    "log_out", "log_in", "port_entropy", "ttl_norm", "log_ttl_var", "is_private",
    "log_bytes_out", "log_bytes_in", "syn_ratio", "ack_ratio", "rst_ratio", "peers_out",
    "peers_in", "avg_size", "retrans_rate", "tcp_window_norm",
]
