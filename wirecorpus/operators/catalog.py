"""Fixed values the corpora and prompts depend on.

Everything in this module is data that must equal the published corpora for results to match:
field lists, task templates, question catalogues, literal replacements and markers.
"""

from __future__ import annotations

# --- fixed values: extracted packet fields, in output order -------------------------------
PACKET_FIELDS = """
frame.encap_type frame.time frame.offset_shift frame.time_epoch frame.time_delta
frame.time_relative frame.number frame.len frame.marked frame.protocols
eth.dst eth.dst_resolved eth.src eth.src_resolved eth.type
ip.version ip.hdr_len ip.dsfield ip.dsfield.dscp ip.dsfield.ecn ip.len ip.id
ip.flags ip.flags.rb ip.flags.df ip.flags.mf ip.frag_offset ip.ttl ip.proto
ip.checksum ip.checksum.status ip.src ip.dst
tcp.srcport tcp.dstport tcp.stream tcp.len tcp.seq tcp.nxtseq tcp.ack tcp.hdr_len
tcp.flags tcp.flags.res tcp.flags.ns tcp.flags.cwr tcp.flags.ecn tcp.flags.urg
tcp.flags.ack tcp.flags.push tcp.flags.reset tcp.flags.syn tcp.flags.fin tcp.flags.str
tcp.window_size tcp.window_size_scalefactor tcp.checksum tcp.checksum.status
tcp.urgent_pointer tcp.time_relative tcp.time_delta tcp.analysis.bytes_in_flight
tcp.analysis.push_bytes_sent tcp.segment tcp.segment.count tcp.reassembled.length
tcp.payload udp.srcport udp.dstport udp.length udp.checksum udp.checksum.status
udp.stream data.len
""".split()

# the online variant leaves the two addresses out
SERVER_FIELDS = [f for f in PACKET_FIELDS if f not in ("ip.src", "ip.dst")]

# fields printed as 0x%08x
HEX_FIELDS = {
    "eth.type", "ip.dsfield", "ip.id", "ip.flags", "ip.checksum",
    "tcp.flags", "tcp.checksum", "udp.checksum",
}
# fields printed as seconds with nine decimals, held as microseconds
SECONDS_FIELDS = {
    "frame.offset_shift", "frame.time_epoch", "frame.time_delta", "frame.time_relative",
    "tcp.time_relative", "tcp.time_delta",
}
TCP_PAYLOAD_CHARS = 1000
PACKET_HEX_CHARS = 1024
FLOW_PACKETS = 10
FLOW_PACKET_CHARS = 256
PACKET_MARK = "<pck>"

# --- fixed values: detection templates; {g} is the granularity ----------------------------
DETECTION_LEAD = (
    "Given the following traffic data <{g}> that contains protocol fields, traffic features, "
    "and payloads. Please conduct the "
)
MALWARE_CATEGORIES = (
    "'BitTorrent, FTP, Facetime, Gmail, MySQL, Outlook, SMB, Skype, Weibo, WorldOfWarcraft,"
    "Cridex, Geodo, Htbot, Miuref, Neris, Nsis-ay, Shifu, Tinba, Virut, Zeus'"
)
VPN_CATEGORIES = (
    "'aim, bittorrent, email, facebook, ftps, hangout, icq, netflix, sftp, skype, spotify, "
    "vimeo, voipbuster, youtube'"
)
BOTNET_CATEGORIES = "'IRC, Neris, RBot, Virut, normal'"
TOR_CATEGORIES = "'audio, browsing, chat, file, mail, p2p, video, voip'"

DETECTION_TEMPLATES = {
    "EMD": DETECTION_LEAD
    + "ENCRYPTED MALWARE DETECTION TASK to determine which application category the encrypted "
    "beign or malicious traffic belongs to. The categories include " + MALWARE_CATEGORIES + ".",
    "EAC": DETECTION_LEAD
    + "ENCRYPTED APP CLASSIFICATION TASK to determine which APP category the encrypted traffic "
    "belongs to. ",
    "BND": DETECTION_LEAD
    + "BOTNET DETECTION TASK to determine which type of network the traffic belongs to. "
    "The categories include " + BOTNET_CATEGORIES + ".",
    "EVD": DETECTION_LEAD
    + "ENCRYPTED VPN DETECTION TASK to determine which behavior or application category the VPN "
    "encrypted traffic belongs to. The categories include " + VPN_CATEGORIES + ".",
    "MDD": "Below is a traffic {g}. Please conduct the malicious DoH detection task: ",
    "TBD": DETECTION_LEAD
    + "TOR BEHAVIOR DETECTION TASK to determine which behavior or application category the "
    "traffic belongs to under the Tor network. The categories include " + TOR_CATEGORIES + ".",
    "APT": DETECTION_LEAD
    + "APT DETECTION TASK to determine which behavior or application category the traffic "
    "belongs to under the APT attacks. The categories include 'APT and normal'.",
}
SENTENCE_OUTPUT = "The traffic category is likely to be recognized as {label}."
SENTENCE_TASKS = ("MDD",)

LEGACY_TEMPLATES = {
    "EMD": "Below is a traffic {g}. Please conduct the encrypted malware detection task.",
    "EAC": "Below is a traffic {g}. Please conduct the encrypted App classification task.",
}
LEGACY_MALWARE_OUTPUT = (
    "This might be a {super} traffic {g}. The category is likely to be recognized as {label}."
)
GENERATION_TEMPLATE = "Please generate a {g} of {label} traffic."

# --- fixed values: dataset name to task code; any other dataset is EAC --------------------
DATASET_TASKS = {
    "ustc-tfc-2016": "EMD",
    "iscx-botnet": "BND",
    "iscx-vpn-2016": "EVD",
    "lfett-2021": "EVD",
    "dohbrw-2020": "MDD",
    "iscx-tor-2016": "TBD",
    "dapt-2020": "APT",
}
DEFAULT_TASK = "EAC"

# --- fixed values: prompt templates of the routed second stage, by variant and code -------
HTTP_TEMPLATE = (
    "Classify the given HTTP request into {good} and {bad} categories. "
    "Each HTTP request will consist of three parts: method, URL, and body, presented in JSON "
    "format. If a web attack is detected in an HTTP request, please output an 'exception'. "
    "Only output '{bad}' or '{good}', no additional output is required. "
    "The given HTTP request is as follows:\n"
)
HTTP_BENIGN = HTTP_TEMPLATE.format(good="benign", bad="malicious")
HTTP_NORMAL = HTTP_TEMPLATE.format(good="normal", bad="abnormal")
# the words the second of them asks for
HTTP_SERVICE_WORDS = {"benign": "normal", "malicious": "abnormal"}
PROMPT_LEAD = (
    "Given the following traffic data <packet> that contains protocol fields, traffic features, "
    "and payloads. Please conduct the "
)
ROUTED_TEMPLATES = {
    "MTD": PROMPT_LEAD
    + "ENCRYPTED MALWARE DETECTION TASK to determine which application category the encrypted "
    "beign or malicious traffic belongs to. The categories include " + MALWARE_CATEGORIES + ".\n",
    "BND": PROMPT_LEAD
    + "BOTNET DETECTION TASK to determine which type of network the traffic belongs to. "
    "The categories include " + BOTNET_CATEGORIES + ".\n",
    "WAD": HTTP_BENIGN,
    "AAD": HTTP_NORMAL,
    "EVD": PROMPT_LEAD
    + "encrypted VPN detection task to determine which behavior or application category the VPN "
    "encrypted traffic belongs to. The categories include " + VPN_CATEGORIES + ".\n",
    "TBD": PROMPT_LEAD
    + "TOR BEHAVIOR DETECTION TASK to determine which behavior or application category the "
    "traffic belongs to under the Tor network. The categories include " + TOR_CATEGORIES + ".\n",
}
# the service variant asks normal/abnormal for web attacks and keeps the data marker
SERVICE_TEMPLATES = {**ROUTED_TEMPLATES, "WAD": HTTP_NORMAL}
PROMPT_VARIANTS = {"cli": ROUTED_TEMPLATES, "service": SERVICE_TEMPLATES}
DATA_MARK = "<packet>"

# --- fixed values: the published registry -------------------------------------------------
REGISTRY_PATHS = {
    "NLP": ["instruction/checkpoint-8000/"],
    "MTD": ["ustc-tfc-2016-detection-packet/checkpoint-10000/"],
    "BND": ["iscx-botnet-2014-detection-packet/checkpoint-5000/"],
    "WAD": ["csic-2010-detection-packet/checkpoint-6000/"],
    "AAD": ["dapt-2020-detection-packet/checkpoint-20000/"],
    "EVD": ["iscx-vpn-2016-detection-packet/checkpoint-4000/"],
    "TBD": ["iscx-tor-2016-detection-packet/checkpoint-10000/"],
    "MTG": ["ustc-tfc-2016-generation-packet-header/checkpoint-10000/",
            "ustc-tfc-2016-generation-packet-payload/checkpoint-10000/"],
}
REGISTRY_TASKS = {
    "Malware Traffic Detection": "MTD",
    "Botnet Detection": "BND",
    "Web Attack Detection": "WAD",
    "APT Attack Detection": "AAD",
    "Encrypted VPN Detection": "EVD",
    "Tor Behavior Detection": "TBD",
    "Malware Traffic Generation": "MTG",
}

# --- fixed values: understanding catalogue, family -> [(question, call)] ------------------
UNDERSTANDING = {
    "IP": [
        ("IP Version", "scapy-IP-version"),
        ("IP Header Length", "scapy-IP-ihl"),
        ("Differentiated Services Field", "scapy-IP-tos"),
        ("Total Length", "scapy-IP-len"),
        ("Identification", "scapy-IP-id"),
        ("IP Flags", "scapy-IP-flags"),
        ("Fragment Offset", "scapy-IP-frag"),
        ("Time to Live", "scapy-IP-ttl"),
        ("Protocol", "scapy-IP-proto"),
        ("IP Header Checksum", "scapy-IP-chksum"),
        ("Source Address", "scapy-IP-src"),
        ("Destination Address", "scapy-IP-dst"),
    ],
    "TCP": [
        ("Source Port", "scapy-TCP-sport"),
        ("Destination Port", "scapy-TCP-dport"),
        ("Sequence Number", "scapy-TCP-seq"),
        ("Acknowledge Number", "scapy-TCP-ack"),
        ("TCP Flags", "scapy-TCP-flags"),
        ("Window", "scapy-TCP-window"),
        ("TCP Header Checksum", "scapy-TCP-chksum"),
        ("Urgent Pointer", "scapy-TCP-urgptr"),
        # the published corpus pairs this question with the options call
        ("Destination Address", "scapy-TCP-options"),
    ],
    "UDP": [
        ("Source Port", "scapy-UDP-sport"),
        ("Destination Port", "scapy-UDP-dport"),
        ("UDP Length", "scapy-UDP-len"),
        ("UDP Header Checksum", "scapy-UDP-chksum"),
    ],
    "TLS": [
        ("Content Type", "scapy-TLS-type"),
        ("Record Version", "scapy-TLS-version"),
        ("TLS Message", "scapy-TLS-msg"),
        ("Message Type", "scapy-TLS-msg-msgtype"),
        ("Handshake Version", "scapy-TLS-msg-version"),
        ("Cipher Suites", "scapy-TLS-msg-ciphers"),
        ("Extensions", "scapy-TLS-msg-ext"),
    ],
    "DNS": [
        ("Transaction ID", "scapy-DNS-id"),
        ("Response", "scapy-DNS-qr"),
        ("Opcode", "scapy-DNS-opcode"),
        ("Authoritative", "scapy-DNS-aa"),
        ("Truncated", "scapy-DNS-tc"),
        ("Recursion Desired", "scapy-DNS-rd"),
        ("Recursion Available", "scapy-DNS-ra"),
        ("Z", "scapy-DNS-z"),
        ("Answer Authenticated", "scapy-DNS-ad"),
        ("Non-Authenticated", "scapy-DNS-cd"),
        ("Questions", "scapy-DNS-qdcount"),
        ("Answer RRs", "scapy-DNS-ancount"),
        ("Authority RRs", "scapy-DNS-nscount"),
        ("Additional RRs", "scapy-DNS-arcount"),
        ("Queries", "scapy-DNS-qd"),
        ("Answers", "scapy-DNS-an"),
    ],
    # for the two HTTP families the call ends with the field's own name
    "http.HTTPRequest": [
        (name, f"scapy-http.HTTPRequest-{name}")
        for name in (
            "Headers", "Host", "User-Agent", "Accept", "Connection", "Method", "Path",
            "Http-Version", "Range", "Accept-Language", "Additional-Headers",
        )
    ],
    "http.HTTPResponse": [
        (name, f"scapy-http.HTTPResponse-{name}")
        for name in (
            "Headers", "Accept-Ranges", "Server", "Cache-Control", "Connection", "Date",
            "Content-Length", "Content-Range", "Content-Type", "Last-Modified",
            "Additional-Headers", "Status-Line",
        )
    ],
    # these calls carry their own brackets, so the published answers have two pairs
    "GeoIP": [("source address", "<geoip-src>"), ("destination address", "<geoip-dst>")],
    "JA3": [("client fingerprints", "<ja3-client>"), ("server fingerprints", "<ja3-server>")],
}
ANALYZE_FAMILIES = ("GeoIP", "JA3")
# corrected pairing, used when fix_pairing=True
TCP_NINTH_QUESTION_FIXED = "Options"

# --- fixed values: spacing repairs of sentence pairs, applied in this order ---------------
SPACING_REPAIRS = [
    (" .", "."),
    (" ,", ","),
    (" '", "'"),
    (" ?", "?"),
    (" !", "!"),
    (" :", "!"),
    (" ;", "!"),
    (" n't", "n't"),
    (" v", "n't"),
    ("2 0 0 6", "2006"),
    ("5 5", "55"),
    ("4 0 0", "400"),
    ("1 7-5 0", "1750"),
    ("2 0 %", "20%"),
    ("5 0", "50"),
    ("1 2", "12"),
    ("1 0", "10"),
    ('" ballast water', '"ballast water'),
]

# --- fixed values: prompt formats ---------------------------------------------------------
PROMPT_WITH_INPUT = (
    "Below is an instruction that describes a task, paired with an input that provides further "
    "context. Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:"
)
PROMPT_NO_INPUT = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{instruction}\n\n### Response:"
)
SUMMARY_PROMPT = "Summarize this dialog:\n{dialog}\n---\nSummary:\n{summary}{eos}"
CORRECTION_PROMPT = "Correct this to standard English: {input}\n---\nCorrected: {target}"
ROUND_PAST = "[Round {i}]\n\n问：{q}\n\n答：{a}\n\n"
ROUND_OPEN = "[Round {i}]\n\n问：{q}\n\n答："
INST_OPEN, INST_CLOSE = "[INST]", "[/INST]"
SYS_OPEN, SYS_CLOSE = "<<SYS>>\n", "\n<</SYS>>\n\n"

# --- fixed values: token ids of the chat format -------------------------------------------
CHAT_PREFIX_IDS = (151331, 151333)
CHAT_EOS_ID = 151336
CHAT_ASSISTANT_ID = 151337
IGNORE_ID = -100
SPECIAL_TOKENS = ["[MASK]", "[gMASK]", "[sMASK]", "sop", "eop"]

# --- fixed values: response handling ------------------------------------------------------
CUTOFF_PLACEHOLDER, CUTOFF_TEXT = "[[训练时间]]", "2023年"
FULL_STOP = "。"
SEVERITIES = {0: "Safe", 2: "Low", 4: "Medium", 6: "High"}
SCREEN_MAX_CHARS = 1000
SCREEN_WARN_TOKENS = 512
EMPTY_PROMPT_STATUS = "empty prompt"
