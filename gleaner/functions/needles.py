"""The weighted token table and the word lists that belong to it."""

# Tokens that matter in a script file, with their weights.
WEIGHTS: list[tuple[float, list[str]]] = [
    (10.0, "eval exec shell_exec system passthru proc_open assert create_function pcntl_fork posix_kill posix_setuid".split()),
    (5.0, "base64_decode gzinflate str_rot13 gzuncompress convert_uu rawurldecode urldecode hex2bin bin2hex exif_read_data readgzfile $SISTEMIT_COM_ENC".split()),
    (2.0, ["htmlspecialchars_decode", "hexdec", "chr", "strrev", "goto", "extract", "parse_str", "popen ", "fsockopen", "posix_setsid", "posix_setpgid", "proc_nice", "proc_close", "proc_terminate", "apache_child_terminate", "move_uploaded_file", "$_files", "$auth_pass", "$password", "$pass", "preg_replace"]),
    (0.1, "implode strtr substr mb_substr str_replace substr_replace basename getcwd pathinfo getenv get_current_user fileowner filegroup disk_free_space disk_total_space sys_get_temp_dir fopen file_put_contents file_get_contents url_get_contents stream_get_meta_data copy include require include_once require_once __file__ mail putenv curl_init tmpfile allow_url_fopen ini_set set_time_limit session_start symlink __halt_compiler __compiler_halt_offset__ error_reporting get_magic_quotes_gpc".split()),
]
# What the command-line profile matches beside most of the above; it has no weights.
CLI_ONLY = "` posix_getuid posix_geteuid posix_getegid posix_getpwuid posix_getgrgid posix_mkfifo posix_getlogin posix_ttyname proc_get_status get_cfg_var diskfreespace getlastmo getmyinode getmypid getmyuid getmygid phpinfo php_uname mysql_connect mysqli_connect mysqli_query mysql_query".split()
# Categories that decide multipliers and highlighting.
CRITICAL = ["eval", "exec", "shell_exec", "system", "passthru", "proc_open", "assert", "create_function"]
OBFUSCATION = ["base64_decode", "gzinflate", "str_rot13", "gzuncompress", "convert_uu", "hex2bin", "bin2hex"]
UPLOAD = ["move_uploaded_file", "$_files", "file_put_contents"]
ESSENTIAL = ["eval", "exec", "shell_exec", "system", "passthru", "proc_open", "assert", "create_function", "base64_decode", "str_rot13", "bin2hex", "hex2bin", "gzinflate", "gzuncompress", "$_files", "$auth_pass", "$password", "$pass", "$SISTEMIT_COM_ENC"]
PATTERNS = ["ph.+", "sh.+", "inc", "htaccess"]
CLI_PATTERNS = ["ph.+", "sh.+", "inc"]
UPLOAD_PLACES = ["upload", "cache", "tmp", "images", "media"]

#: Tokens that decide multipliers: critical, obfuscation, upload.
Categories = tuple[list[str], list[str], list[str]]
CATEGORIES: Categories = (CRITICAL, OBFUSCATION, UPLOAD)
WEB = [(token, weight) for weight, tokens in WEIGHTS for token in tokens]
CLI = [(token, None) for token, _ in WEB] + [(token, None) for token in CLI_ONLY]
