"""Small hand-written logs in each supported format (one text per source)."""

KUBERNETES = """
2024-03-01T10:00:00Z [kubelet] Pulling image "shop/api:2.1"
2024-03-01T10:00:05Z [kubelet] Back-off restarting failed container api in pod shop-api-7d9
2024-03-01T10:00:09Z [kubelet] WARNING Liveness probe failed: connection refused
2024-03-01T10:00:12Z [kubelet] pod/shop-api-7d9 status CrashLoopBackOff
2024-03-01T10:00:20Z [kubelet] Container api OOMKilled
"""

DOCKER = """
2024-03-01T11:00:00.123456Z container web started
2024-03-01T11:00:01.000001Z containerd: task exited with code 137
2024-03-01T11:00:02.500000Z web-1 | ERROR listen tcp :80: bind: address already in use
2024-03-01T11:00:03.000000Z web-1 | WARNING slow response
"""

NGINX = """
192.168.1.10 - - [01/Mar/2024:12:00:00 +0000] "GET /index.html HTTP/1.1" 200 512 "-" "curl/8.0"
192.168.1.11 - - [01/Mar/2024:12:00:01 +0000] "POST /api/pay HTTP/1.1" 502 0 "-" "curl/8.0"
192.168.1.12 - - [01/Mar/2024:12:00:02 +0000] "GET /missing HTTP/1.1" 404 -
"""

NGINX_ERROR = """
2024/03/01 12:05:00 [error] 1234#0: *1 connect() failed (111: Connection refused) while connecting to upstream
2024/03/01 12:05:01 [warn] 1234#0: *2 upstream response is buffered
2024/03/01 12:05:02 [crit] 1234#0: *3 SSL_do_handshake() failed
"""

APACHE = """
10.1.1.1 - alice [01/Mar/2024:13:00:00 +0000] "GET /docs HTTP/1.0" 200 2326 "-" "Mozilla/5.0"
10.1.1.2 - bob [01/Mar/2024:13:00:01 +0000] "DELETE /docs/1 HTTP/1.0" 503 -
"""

JENKINS = """
2024-03-01 14:00:00.123 +0000 [id=42] INFO hudson.model.Run execute
[Pipeline] stage
[Pipeline] { (Build)
2024-03-01 14:00:05.456+0000 [id=42] SEVERE: Build failed with exception
Finished: FAILURE
"""

GITHUB_ACTIONS = """
##[group]Run actions/checkout@v4
Run actions/checkout@v4
GITHUB_WORKFLOW=ci
error::file=src/app.ts,line=10,col=5::Type error
warning::title=Deprecated:node 16 is deprecated
##[error]Process completed with exit code 1
"""

TERRAFORM = """
Terraform will perform the following actions:
[DEBUG] 2024-03-01T15:00:00Z provider: starting plugin
[WARN] 2024-03-01T15:00:01Z provider: slow response
Plan: 3 to add, 1 to change, 0 to destroy.
Error: Invalid value for module argument
"""

CLOUDWATCH = """
{"@timestamp": "2024-03-01T16:00:00Z", "@message": "ERROR database timeout", "logStream": "app/1"}
{"@timestamp": 1709308801000, "message": "INFO request served", "logGroup": "/ecs/app"}
{"@timestamp": "2024-03-01T16:00:02Z", "@message": "WARNING retry 2", "logStream": "app/1"}
"""

GENERIC = """
2024-03-01 17:00:00 INFO service starting
2024-03-01 17:00:01 WARNING cache miss ratio high
2024-03-01 17:00:02 ERROR unhandled exception in worker
Mar  1 17:00:03 host app[1]: panic: worker crashed, index out of range
"""
