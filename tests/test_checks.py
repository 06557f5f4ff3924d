"""Hand-written payloads of services, through the registered checks."""

import pytest
from pyspark.sql import functions as F

from tidemark import checks
from tidemark.schema import RAW_SCRAPES
from tidemark.checks.events import Health, check_events
from tidemark.checks.registry import apply_recipes
from tidemark.schema import THRESHOLDS

PAYLOADS = {
    "btrfs": ("[/dev/sda1].write_io_errs   3\n", {("btrfs_dev_sda1_write_io_errs", ()): 3.0}),
    "mysql": ("Queries\t10\nOpen_files\t3\n", {("mysql_queries", ()): 0.0, ("mysql_open_files", ()): 3.0}),
    "disk_io": (
        "8 0 sda 1 2 3 4 5 6 7 8 9 100 11\n8 1 sda1 1 2 3 4 5 6 7 8 9 100 11\n7 0 loop0 1 2 3 4 5 6 7 8 9 100 11\n",
        {("drive_io_percent_used", (("drive", "sda"),)): 0.0},
    ),
    "tomcat": (
        "HeapMemoryUsage: javax.management(contents={committed=5, init=6})\nThreadCount: 9\n{duration=12, x=1}{duration=3.5}",
        {("tomcat_heap_committed", ()): 5.0, ("tomcat_heap_init", ()): 6.0, ("tomcat_threadcount", ()): 9.0,
         ("tomcat_lastgc_0", ()): 12.0, ("tomcat_lastgc_1", ()): 3.5},
    ),
    "hbase_thrift": (
        '{"beans":[{"name":"Hadoop:service=HBase,name=Thrift,sub=ThriftOne","callQueueLen":4,"BatchGet_num_ops":7},'
        '{"name":"Hadoop:service=HBase,name=Thrift,sub=ThriftTwo","callQueueLen":5},{"name":"x","callQueueLen":6}]}',
        {("hthrift_callqueuelen", (("thrift_queue", "one"),)): 4.0, ("hthrift_callqueuelen", (("thrift_queue", "two"),)): 5.0,
         ("hthrift_batchget", (("thrift_queue", "one"),)): 0.0},
    ),
    "hbase_regionserver": ('{"beans":[{"name":"a","regionCount":3,"hedgedReads":0,"totalRequestCount":5}]}',
                           {("hregion_node_regioncount", ()): 3.0, ("hregion_node_totalrequestcount", ()): 0.0}),
    "cassandra3": (
        '{"value":{"org.apache.cassandra.metrics:name=RegularStatementsExecuted,type=CQL":{"Count":5},'
        '"org.apache.cassandra.metrics:name=Latency,scope=Read,type=ClientRequest":{"Mean":1.5},'
        '"org.apache.cassandra.metrics:name=Latency,scope=Write,type=ClientRequest":{"Mean":0},'
        '"org.apache.cassandra.metrics:name=Hits,scope=KeyCache,type=Cache":{"OneMinuteRate":2.5}}}',
        {("cassa_cql_regularstatementsexecuted", ()): 0.0, ("cassa_latency_read", ()): 1.5, ("cassa_hits_keycache", ()): 2.5},
    ),
    "foundationdb": (
        '{"cluster":{"workload":{"bytes":{"read":{"counter":5}}},"machines":{"m1":{"address":"10.0.0.1","memory":{"free_bytes":3}}},'
        '"data":{"moving_data":{"in_flight_bytes":2},"partitions_count":4}}}',
        {("fdb_bytes_read", ()): 0.0, ("fdb_memory_free_bytes", (("node", "10.0.0.1"),)): 3.0,
         ("fdb_moving_data", (("fdb_move_type", "in_flight_bytes"),)): 2.0, ("fdb_partitions_count", ()): 4.0},
    ),
    "mesos_marathon": (
        '{"gauges":{"marathon.jvm.memory.non-heap.used.gauge.bytes":{"value":7},"marathon.jvm.gc.g1.collections.gauge":{"value":2}}}',
        {("mesos_marathon_nonheap_used", ()): 7.0, ("mesos_marathon_gc_collections", (("gctype", "g1"),)): 2.0},
    ),
    "mesos_chronos": (
        '{"gauges":{"jvm.memory.heap.used":{"value":7},"jvm.gc.PS Scavenge.count":{"value":2}},"counters":{"jobs.run.success.my job":{"count":3}}}',
        {("mesos_chronos_heap_used", ()): 7.0, ("mesos_chronos_gc_collections", (("gctype", "ps_scavenge"),)): 2.0,
         ("mesos_chronos_jobs_success", (("chronos_jobname", "my_job"),)): 3.0},
    ),
    "rabbitmq_queues": ('[{"name":"a.b","messages":4}]', {("rabbitmq_messages", (("queue", "a_b"),)): 4.0}),
    "couchdb_2x": ('{"couchdb":{"database_reads":{"value":4},"httpd":{"requests":{"value":9}}}}',
                   {("couchdb_database_reads", ()): 0.0, ("couchdb_requests", ()): 0.0}),
    "redis": (
        "# Server\r\nused_memory:100\r\nkeyspace_hits:9\r\nused_memory:200\r\nother:1\r\nmem_fragmentation_ratio:1.5",
        {("redis_used_memory", ()): 200.0, ("redis_mem_fragmentation_ratio", ()): 1.5, ("redis_keyspace_hits", ()): 0.0},
    ),
    "memcached": (
        "STAT curr_items 7\r\nSTAT bytes 5\r\nEND",
        {("memcached_curr_items", ()): 7.0, ("memcached_bytes", ()): 0.0},
    ),
    "zookeeper": (
        "zk_version\t3.4\nzk_packets_sent\t10\nzk_znode_count\t4\n",
        {("zk_packets_sent", ()): 0.0, ("zk_znode_count", ()): 4.0},
    ),
    "lighttpd": (
        "Total Accesses: 12\nTotal kBytes: 3\nBusyServers: 1\nIdleServers: 9\nScoreboard: __",
        {("lighttpd_accesses", ()): 0.0, ("lighttpd_kbytes", ()): 0.0, ("lighttpd_busyservers", ()): 1.0, ("lighttpd_idleservers", ()): 9.0},
    ),
    "nginx": (
        "Active connections: 2 \nserver accepts handled requests\n 16630948 16630946 31070465 \nReading: 6 Writing: 179 Waiting: 106 \n",
        {("nginx_connections", ()): 2.0, ("nginx_requests", ()): 0.0, ("nginx_handled", ()): 0.0, ("nginx_accept", ()): 0.0,
         ("nginx_reading", ()): 6.0, ("nginx_writing", ()): 179.0, ("nginx_waiting", ()): 106.0},
    ),
    "memory": (
        "MemTotal:  16 kB\nMemAvailable: 4 kB\nSwapCached: 3 kB\nMemTotal:  32 kB",
        {("mem_total", ()): 32768.0, ("mem_available", ()): 4096.0, ("mem_used_percent", ()): 87.5},
    ),
    "load_average": (
        "0.50 0.40 0.30 1/200 99\ncpu 1 2 3\ncpu0 1 2 3\ncpu1 1 2 3\n",
        {("sys_load_1", ()): 0.5, ("sys_load_5", ()): 0.4, ("sys_load_15", ()): 0.3},
    ),
    "mounts": (
        "/ 30 60 90\n/var/log 5 5\n/proc 0 0 0",
        {("drive_bytes_used", (("mountpoint", "rootfs"),)): 30.0, ("drive_bytes_available", (("mountpoint", "rootfs"),)): 60.0,
         ("drive_percent_used", (("mountpoint", "rootfs"),)): 33.33,
         ("drive_bytes_used", (("mountpoint", "var_log"),)): 5.0, ("drive_bytes_available", (("mountpoint", "var_log"),)): 5.0,
         ("drive_bytes_used", (("mountpoint", "proc"),)): 0.0, ("drive_bytes_available", (("mountpoint", "proc"),)): 0.0},
    ),
    "disk_bytes": (
        "sda 512 1 2 100 3 4 5 200 6 7 8 9\nloop0 512 1 2 100 3 4 5 200 6",
        {("drive_reads", (("drive", "sda"),)): 0.0, ("drive_writes", (("drive", "sda"),)): 0.0},
    ),
    "udpconn": ("sl local\n1: a\n2: b\n", {("udp_clients", (("flag", "udp"),)): 3.0}),
    "cpu": ("cpu 10 0 5 85 0 0 0\ncpu0 10 0 5 85 0 0 0\nintr 1", {}),
    "activemq": (
        '{"value":{"java.lang:type=Memory":{"HeapMemoryUsage":{"used":1,"committed":2,"max":3,"init":4}},'
        '"java.lang:name=ParNew,type=GarbageCollector":{"Name":"ParNew","CollectionCount":3,"CollectionTime":40,"LastGcInfo":{"duration":5}},'
        '"java.lang:name=ConcurrentMarkSweep,type=GarbageCollector":{"Name":"ConcurrentMarkSweep","CollectionCount":1,"CollectionTime":9,"LastGcInfo":null},'
        '"java.lang:name=G1 Young Generation,type=GarbageCollector":{"Name":"G1 Young Generation","CollectionCount":8,"CollectionTime":8,"LastGcInfo":null},'
        '"java.lang:type=Threading":{"ThreadCount":7},"org.apache.activemq:brokerName=b,type=Broker":{"TotalMessageCount":12,"Other":1}}}',
        {("activemq_heap_used", ()): 1.0, ("activemq_heap_committed", ()): 2.0, ("activemq_heap_max", ()): 3.0, ("activemq_threadcount", ()): 7.0,
         ("activemq_parnew_lastgcinfo", ()): 5.0, ("activemq_parnew_collectioncount", ()): 3.0, ("activemq_parnew_collectiontime", ()): 0.0,
         ("activemq_cms_lastgcinfo", ()): 0.0, ("activemq_cms_collectioncount", ()): 1.0, ("activemq_cms_collectiontime", ()): 0.0,
         ("activemq_totalmessagecount", ()): 12.0},
    ),
    "spark_master": (
        '{"value":{"java.lang:name=G1 Old Generation,type=GarbageCollector":{"Name":"G1 Old Generation","CollectionCount":0,"CollectionTime":0,"LastGcInfo":null},'
        '"java.lang:name=G1 Young Generation,type=GarbageCollector":{"Name":"G1 Young Generation","CollectionCount":8,"CollectionTime":80,"LastGcInfo":{"duration":3}}}}',
        {("spark_master_g1_old_lastgcinfo", ()): 0.0, ("spark_master_g1_old_collection_count", ()): 0.0, ("spark_master_g1_old_collectiontime", ()): 0.0,
         ("spark_master_g1_young_lastgcinfo", ()): 3.0, ("spark_master_g1_young_collection_count", ()): 8.0, ("spark_master_g1_young_collectiontime", ()): 0.0},
    ),
    "kafka": (
        '{"value":{"kafka.server:name=BytesInPerSec,type=BrokerTopicMetrics":{"OneMinuteRate":2.5,"Count":9},'
        '"kafka.network:name=RequestsPerSec,request=Produce,type=RequestMetrics":{"Count":50},"java.lang:type=Threading":{"ThreadCount":4}}}',
        {("kafka_bytesinpersec", ()): 2.5, ("kafka_produce", ()): 0.0, ("kafka_threadcount", ()): 4.0},
    ),
    "cassandra2": (
        '{"value":{"org.apache.cassandra.db:type=Caches":{"RowCacheHits":0,"KeyCacheHits":5},'
        '"org.apache.cassandra.request:type=ReadStage":{"CompletedTasks":7,"PendingTasks":1},'
        '"org.apache.cassandra.transport:type=Native-Transport-Requests":{"CompletedTasks":3},'
        '"org.apache.cassandra.metrics:name=PendingTasks,type=Compaction":{"Value":2}}}',
        {("cassa_keycachehits", ()): 0.0, ("cassa_readstage", ()): 0.0, ("cassa_native_transport_requests", ()): 0.0, ("cassa_pending_compactions", ()): 2.0},
    ),
    "elasticsearch_health": (
        '{"cluster_name":"c","status":"yellow","active_shards":5,"relocating_shards":0,"initializing_shards":1,"unassigned_shards":2}',
        {("elasticsearch_active_shards", ()): 5.0, ("elasticsearch_relocating_shards", ()): 0.0,
         ("elasticsearch_initializing_shards", ()): 1.0, ("elasticsearch_unassigned_shards", ()): 2.0},
    ),
    "ceph": (
        '{"health":{"status":"HEALTH_WARN","checks":{"PG_DEGRADED":{"summary":"Degraded data: 12/300 objects degraded (4.000%), 3 pgs"}}},'
        '"pgmap":{"bytes_avail":10,"bytes_total":30,"bytes_used":20,"data_bytes":5,"num_pgs":8,"write_bytes_sec":7}}',
        {("ceph_bytes_avail", ()): 10.0, ("ceph_bytes_total", ()): 30.0, ("ceph_bytes_used", ()): 20.0, ("ceph_data_bytes", ()): 5.0, ("ceph_num_pgs", ()): 8.0,
         ("ceph_write_bytes_sec", ()): 7.0, ("ceph_degraded_percent", ()): 4.0, ("ceph_misplaced_percent", ()): 0.0,
         **{(f"ceph_{n}", ()): 0.0 for n in ("read_bytes_sec", "degraded_objects", "degraded_ratio", "degraded_total", "misplaced_objects",
            "misplaced_ratio", "misplaced_total", "recovering_bytes_per_sec", "num_objects_recovered", "recovering_keys_per_sec")}},
    ),
    "ceph_osd": (
        '{"nodes":[{"name":"osd.0","utilization":1.5,"kb_avail":10,"kb_used":2}]}',
        {("ceph_osd_utilization", (("osd_name", "osd.0"),)): 1.5, ("ceph_osd_space_avail", (("osd_name", "osd.0"),)): 10.0,
         ("ceph_osd_space_used", (("osd_name", "osd.0"),)): 2.0},
    ),
    "storm_topology": (
        '{"name":"t1","topologyStats":[{"windowPretty":"10m 0s","emitted":1},{"windowPretty":"All time","emitted":9,"transferred":0,"acked":null}]}',
        {("storm_emitted", (("name", "t1"),)): 9.0, ("storm_acked", (("name", "t1"),)): 0.0, ("storm_failed", (("name", "t1"),)): 0.0},
    ),
    "hdfs_dirsize": (
        '{"/user/web logs/":{"length":5,"directoryCount":1,"spaceConsumed":15,"fileCount":2}}',
        {(f"hdfs_dir_{n}", (("hadoop_dir", "user_web_logs"),)): v for n, v in (("length", 5.0), ("directorycount", 1.0), ("spaceconsumed", 15.0), ("filecount", 2.0))},
    ),
    "elasticsearch_totals": (
        '{"_shards":{"total":6},"_all":{"primaries":{"docs":{"count":100}},"total":{"store":{"size_in_bytes":9}}}}',
        {("elasticsearch_cluster_docs", ()): 100.0, ("elasticsearch_cluster_ingest_rate", ()): 0.0, ("elasticsearch_cluster_shards", ()): 6.0,
         ("elasticsearch_cluster_storage_usage", ()): 9.0},
    ),
    "docker": (
        '{"name":"/web","cpu_stats":{"cpu_usage":{"total_usage":300,"x":1},"system_cpu_usage":2000,"throttling_data":{"throttled_periods":1,"throttled_time":2}},'
        '"precpu_stats":{"cpu_usage":{"total_usage":100,"x":1},"system_cpu_usage":1000},"memory_stats":{"usage":7,"stats":{"active_anon":3}},'
        '"networks":{"eth0":{"rx_bytes":10,"tx_bytes":20,"rx_errors":0,"rx_packets":5}}}',
        {("docker_master_cpu_usage", (("container", "web"),)): 20.0, ("docker_cpu_throttled_periods", (("container", "web"),)): 1.0,
         ("docker_cpu_throttled_time", (("container", "web"),)): 2.0, ("docker_mem_cur_usage", (("container", "web"),)): 7.0,
         ("docker_mem_active_anon", (("container", "web"),)): 3.0, ("docker_bytes_rx_eth0", (("container", "web"),)): 10.0,
         ("docker_bytes_tx_eth0", (("container", "web"),)): 20.0, ("docker_rx_errors_eth0", (("container", "web"),)): 0.0,
         ("docker_rx_packets_eth0", (("container", "web"),)): 0.0, ("docker_container_cpu_usage", (("container", "web"),)): 30.0},
    ),
    "haproxy": (
        "# pxname,svname,rate,conn_tot\nweb,BACKEND,4,\nweb,FRONTEND,9,1\n",
        {("haproxy_rate", (("appname", "web"),)): 4.0},
    ),
    "network_bytes": (
        "lo 5 5\neth0 10 20",
        {("bytes_rx", (("interface", "eth0"),)): 0.0, ("bytes_tx", (("interface", "eth0"),)): 0.0},
    ),
    "scripts": ("m1 5 t1 stack\nm2 7 t2 rate\n", {("m1", ()): 5.0, ("m2", ()): 0.0}),
    "coredns": (
        "# c\ncoredns_up 1\nprocess_fds 3\nlabelled{a=\"b\"} 4\n",
        {("coredns_up", ()): 1.0, ("coredns_process_fds", ()): 3.0},
    ),
    "kube_state_metrics": (
        'kube_deployment_status_replicas{deployment="d",namespace="n"} 2\nother{a="b"} 1',
        {("kube_deployment_status_replicas", (("deployment", "d"),)): 2.0},
    ),
    "coturn": (
        'turn_traffic_sentb{user="u,1"} 5\nprocess_open_fds 9\n',
        {("coturn_turn_traffic_sentb", (("user", "u,1"),)): 0.0, ("coturn_process_open_fds", ()): 9.0},
    ),
    "scylla": (
        'scylla_cql_reads{shard="0"} 5\nscylla_cql_reads{shard="1"} 7\n'
        'scylla_storage_proxy_coordinator_read_latency_sum{shard="0",scheduling_group_name="main"} 30\n'
        'scylla_storage_proxy_coordinator_read_latency_sum{shard="1",scheduling_group_name="main"} 12\n'
        'scylla_storage_proxy_coordinator_read_latency_count{shard="0",scheduling_group_name="main"} 8\n'
        'scylla_cache_bytes_used{shard="0"} 3\nscylla_cache_bytes_used{shard="1"} 4\n',
        {("scylla_cql_reads", ()): 0.0, ("scylla_cache_bytes_used", ()): 7.0,
         ("scylla_storage_proxy_coordinator_read_latency", (("scheduling_group", "main"),)): 5.25},
    ),
    "traefik": (
        'traefik_service_requests_total{code="200",protocol="http"} 5\ntraefik_service_requests_total{code="404",protocol="http"} 6\n'
        'traefik_service_request_duration_seconds_sum{code="200",protocol="http"} 1.5\nprocess_fds 3\n',
        {("traefik_totalrequests", ()): 0.0, ("traefik_process_fds", ()): 3.0,
         ("traefik_service_http_duration_seconds_sum", (("status_code", "200"),)): 1.5},
    ),
    "hadoop_datanode": (
        '{"beans":[{"name":"java.lang:type=Memory","HeapMemoryUsage":{"used":1,"max":2,"init":0,"committed":2}},'
        '{"name":"gc","Name":"ConcurrentMarkSweep","CollectionCount":3,"CollectionTime":40,"LastGcInfo":{"duration":6}},'
        '{"name":"gc2","Name":"idle","CollectionCount":3,"CollectionTime":40,"LastGcInfo":null},'
        '{"name":"i","Capacity":5,"BytesRead":9},{"name":"j","Capacity":6}]}',
        {("datanode_heap_used", ()): 1.0, ("datanode_heap_max", ()): 2.0, ("datanode_heap_init", ()): 0.0,
         ("datanode_heap_committed", ()): 2.0, ("datanode_capacity", ()): 6.0, ("datanode_bytesread", ()): 0.0,
         ("datanode_lastgcinfo", (("gctype", "cms"),)): 6.0, ("datanode_gc_collectioncount", (("gctype", "cms"),)): 3.0,
         ("datanode_gc_collectiontime", (("gctype", "cms"),)): 40.0},
    ),
    "jolokia": (
        '{"value":{"java.lang:name=G1 Young Generation,type=GarbageCollector":{"Name":"G1 Young Generation",'
        '"CollectionCount":3,"CollectionTime":40,"LastGcInfo":null}}}',
        {("jolokia_lastgcinfo", (("gctype", "g1_young"),)): 0.0, ("jolokia_gc_collectioncount", (("gctype", "g1_young"),)): 3.0,
         ("jolokia_gc_collectiontime", (("gctype", "g1_young"),)): 40.0},
    ),
    "jetty": (
        '{"value":{"HeapMemoryUsage":{"used":1,"committed":2,"max":3},"NonHeapMemoryUsage":{"used":4},"Verbose":false}}',
        {("jetty_heap_used", ()): 1.0, ("jetty_heap_committed", ()): 2.0, ("jetty_heap_max", ()): 3.0, ("jetty_nonheap_used", ()): 4.0},
    ),
    "varnish": ('{"MAIN.threads":{"value":5},"MAIN.sess_conn":{"value":8}}', {("varnish_threads", ()): 5.0, ("varnish_sess_conn", ()): 0.0}),
    "riak": ('{"node_gets":120,"mem_allocated":7}', {("riak_node_gets", ()): 2.0, ("riak_mem_allocated", ()): 7.0}),
    "mesos_master": ('{"master/cpus_percent":0.5,"registrar/state_store_ms/p99":2}',
                     {("mesos_master_cpus_percent", ()): 0.5, ("mesos_registrar_state_store_ms_p99", ()): 2.0}),
    "elasticsearch": (
        '{"nodes":{"n1":{"jvm":{"mem":{"heap_used_in_bytes":7},"gc":{"collectors":{"young":{"collection_count":4,"collection_time_in_millis":10},'
        '"old":{"collection_count":0,"collection_time_in_millis":0}}}},"thread_pool":{"get":{"active":1,"queue":2,"size":9}}},'
        '"n2":{"jvm":{"mem":{"heap_used_in_bytes":8}}}}}',
        {("elasticsearch_heap_used", ()): 7.0, ("elasticsearch_gc_young_count", ()): 0.0, ("elasticsearch_gc_old_count", ()): 0.0,
         ("elasticsearch_gc_young_time_ms", ()): 2.5, ("elasticsearch_gc_old_time_ms", ()): 0.0, ("elasticsearch_thread_pool", (("pool", "get"),)): 1.0},
    ),
    "mongodb": ('{"opcounters":{"insert":3},"connections":{"current":4}}',
                {("mongo_opcounters_insert", ()): 0.0, ("mongo_connections_current", ()): 4.0}),
    "twemproxy": ('{"curr_connections":9,"proxy":{"client_connections":1,"b1":{"requests":5,"in_queue":2}}}',
                  {("twemproxy_current_connections", ()): 9.0, ("twemproxy_client_connections", ()): 1.0,
                   ("twemproxy_requests", (("backend", "b1"),)): 0.0, ("twemproxy_in_queue", (("backend", "b1"),)): 2.0}),
    "hashicorp_vault": ('{"Gauges":[{"Name":"a.b-c","Value":1}],"Counters":[],"Samples":[{"Name":"s","Rate":0.5,"Count":9}]}',
                        {("a_b_c", ()): 1.0, ("s", ()): 0.5}),
    "hashicorp_nomad": (
        '{"Gauges":[{"Name":"nomad.nomad.job_summary.lost","Value":2,"Labels":{"job":"a/b"}},{"Name":"x","Value":1}],"Counters":[],"Samples":[]}',
        {("nomad_job_summary_lost", (("nomad_jobname", "a_b"),)): 2.0},
    ),
    "proxy": (
        'proxy_requests_total 5\nproxy_responses_total{status="200"} 7\nproxy_up 1\n'
        'proxy_request_latency_seconds_bucket{le="0.1"} 10\nproxy_request_latency_seconds_bucket{le="0.5"} 30\n'
        'proxy_request_latency_seconds_bucket{le="1.0"} 40\nproxy_request_latency_seconds_bucket{le="+Inf"} 40\n',
        {("proxy_requests", ()): 0.0, ("proxy_responses", (("status", "200"),)): 0.0, ("proxy_up", ()): 1.0,
         **{("proxy_request_latency", (("percentile", p),)): v for p, v in
            {"50": 0.3, "75": 0.5, "85": 0.7, "90": 0.8, "95": 0.9, "99": 0.98}.items()}},
    ),
}


@pytest.fixture(scope="module")
def derived(spark):
    rows = [("h1", s, "c1", 1000, "text", p) for s, (p, _) in PAYLOADS.items()]
    rows += [("h2", s, "c1", 1000, "text", bad) for s in PAYLOADS for bad in ("", "{broken", "\n\n", None)]
    raw = spark.createDataFrame(rows, RAW_SCRAPES)
    used = [c for c in checks.registered().values() if c.source in PAYLOADS]
    return checks.run_checks(raw, used).collect()


@pytest.mark.parametrize("source", sorted(PAYLOADS))
def test_payload_gives_samples(derived, source):
    want = PAYLOADS[source][1]
    mine = [r for r in derived if r["source"] == source and r["host"] == "h1"]
    # Threads that queue differ from active ones in their type only.
    mine = [r for r in mine if r["check_type"] != "queue"]
    got = {(r["name"], tuple(sorted((r["tags"] or {}).items()))): r["value"] for r in mine}
    assert len(got) == len(mine)
    assert {k: None if v is None else round(v, 6) for k, v in got.items()} == want


def test_broken_payloads_give_nothing(derived):
    # Counts of lines have no malformed input: any line is one.
    assert [(r["source"], r["name"], r["value"]) for r in derived if r["host"] == "h2" and r["name"] != "udp_clients"] == []


def test_recipes_are_data(spark):
    table = checks.recipe_table(spark, checks.registered().values())
    assert table.groupBy("source", "match").count().filter("count > 1").count() == 0
    off = table.withColumn("enabled", F.col("match") != "used_memory")
    raw = spark.createDataFrame([("h", "redis", "c", 1, "text", "used_memory:1\nconnected_clients:2")], RAW_SCRAPES)
    got = checks.run_checks(raw, [checks.registered()["redis"]], off).collect()
    assert [r["name"] for r in got] == ["redis_connected_clients"]


def test_user_check(spark):
    from tidemark.sources.text import extract_kv_lines

    mine = checks.Check("mine", lambda df: extract_kv_lines(df, "="), [checks.Recipe("a", "my_a", "rate")], "custom")
    raw = spark.createDataFrame(
        [("h", "mine", "c1", 0, "text", "a=10\nb=1"), ("h", "mine", "c2", 20, "text", "a=50")], RAW_SCRAPES
    )
    got = {r["ts_s"]: (r["name"], r["value"], r["check_type"]) for r in checks.run_checks(raw, [mine]).collect()}
    assert got == {0: ("my_a", 0.0, "custom"), 20: ("my_a", 2.0, "custom")}


def test_rate_forms(spark):
    from tidemark.checks.registry import derive

    rows = [("h", "s", "a", style, ts, ts, v) for style in ("rate", "rate_int", "rate_tenth", "delta") for ts, v in ((0, 10), (8, 95))]
    df = spark.createDataFrame(rows, "host STRING, source STRING, name STRING, style STRING, ts_s BIGINT, seq BIGINT, v BIGINT")
    df = df.withColumn("tags", F.create_map().cast("map<string,string>")).withColumn("value_raw", F.col("v").cast("string"))
    df = df.withColumn("value_kind", F.lit("int")).withColumn("value", F.col("v").cast("double")).drop("v")
    got = {r["style"]: r["value"] for r in derive(df).filter("ts_s = 8").collect()}
    assert got == {"rate": 10.62, "rate_int": 10.0, "rate_tenth": 1.06, "delta": 85.0}


def test_cpu_shares_and_sockets(spark):
    from tidemark.checks.text_services import cpu_shares, sockets

    pages = [("h", "c1", 0, "cpu 10 0 5 85 0 0 0\ncpu0 10 0 5 85 0 0 0\nintr 1"), ("h", "c2", 20, "cpu 20 0 10 170 0 0 0\ncpu0 10 0 5 85 0 0 0"),
             ("h", "c3", 40, "cpu 40 0 10 250 0 0 0\ncpu0 20 0 10 170 0 0 0")]
    raw = spark.createDataFrame(pages, "host STRING, scrape_id STRING, ts_s BIGINT, payload STRING")
    got = {(r["scrape_id"], r["tags"]["core"], r["name"]): r["value"] for r in cpu_shares(raw).collect()}
    assert got["c2", "all", "cpu_load"] == 0.0 and got["c3", "all", "cpu_load"] == 20.0 and got["c3", "all", "cpu_idle"] == 80.0
    assert ("c2", "core0", "cpu_load") not in got and got["c3", "core0", "cpu_user"] == 0.0
    table = spark.createDataFrame([("h", "sl local rem st\n0: a b 0A x\n1: a b 03 x\n2: a b 04 x")], "host STRING, payload STRING")
    flags = {r["tags"]["flag"]: r["value"] for r in sockets(table).collect()}
    assert flags["last_ack"] == 1.0 and flags["syn_recv"] == 2.0 and flags["closing"] == 0.0 and len(flags) == 13


RAW = "host string, source string, scrape_id string, ts_s bigint, format string, payload string"


def test_one_scan_and_rejects_with_reasons(spark, scratch):
    from tidemark.checks.registry import open_for
    from tidemark.sources.opened import opening

    rows = [
        ("h", "varnish", "c1", 1, "text", '{"MAIN.threads":{"value":5}}'), ("h", "varnish", "c2", 1, "text", '{"MAIN.th'),
        ("h", "varnish", "c3", 1, "text", '{"a":1,"a":2}'), ("h", "coredns", "c1", 1, "text", 'up 1\nbad{x="1" 5\nnovalue\n1x 5\n# c\n'),
        ("h", "coredns", "c2", 1, "text", None), ("h", "redis", "c1", 1, "text", " \n"), ("h", "jolokia", "c1", 1, "text", "oops"),
        ("h", "hashicorp_vault", "c1", 1, "text", "{]}"), ("h", "nobody", "c1", 1, "text", "{"),
    ]
    spark.createDataFrame(rows, RAW).write.parquet(scratch + "/raw")
    raw = spark.read.parquet(scratch + "/raw")
    known = checks.registered().values()
    got = {(r["source"], r["scrape_id"], r["reason"], r["position"]) for r in open_for(raw, known).rejects.collect()}
    assert got == {
        ("varnish", "c2", "cut off", 9), ("varnish", "c3", "malformed JSON", None), ("coredns", "c2", "missing", None), ("redis", "c1", "empty", None),
        ("jolokia", "c1", "not JSON", 0), ("hashicorp_vault", "c1", "malformed JSON", None),
        ("coredns", "c1", "labels not closed", 1), ("coredns", "c1", "no value", 2), ("coredns", "c1", "bad name", 3),
    }

    def scans(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan.count("FileScan"), plan.count(scratch)

    forms = {c.source: c.form for c in known}
    assert scans(opening(raw, forms))[0] == 1
    # The result reads what was opened and extracted; the scrapes are not read again.
    assert scans(checks.run_checks(raw, known, rejects_path=scratch + "/rejects"))[1] == 0
    assert spark.read.parquet(scratch + "/rejects").count() == 9


def test_events_beside_samples(spark):
    pages = [
        ("h", "memory", "c1", 10, "text", "MemTotal: 100 kB\nMemAvailable: 5 kB"), ("h", "memory", "c2", 30, "text", "MemTotal: 100 kB\nMemAvailable: 50 kB"),
        ("h", "load_average", "c1", 10, "text", "0.2 0.4 0.3\ncpu 1\ncpu0 1\ncpu1 1"), ("h", "load_average", "c2", 30, "text", "3 0.4 0.3\ncpu 1\ncpu0 1\ncpu1 1"),
        ("h", "mounts", "c1", 10, "text", "/ 85 15 100\n/data 1 99 100"),
        ("h", "btrfs", "c1", 10, "text", "[/dev/sda].write_io_errs 3\n[/dev/sda].read_io_errs 0"),
        ("h", "elasticsearch_health", "c1", 10, "text", '{"cluster_name":"c","status":"red","active_shards":5,"relocating_shards":0,"initializing_shards":1}'),
    ]
    limits = spark.createDataFrame([
        ("mem_used_percent", 80.0, 90.0, False, True), ("sys_load_percent", 90.0, 100.0, False, True), ("drive_percent_used", 80.0, 90.0, False, True),
    ], "metric string, warn double, crit double, emit_ok boolean, enabled boolean")
    known = checks.registered()
    used = [known[n] for n in ("memory", "load_average", "mounts", "btrfs", "btrfs_errors", "elasticsearch_health")]
    samples, events = checks.run_with_events(spark.createDataFrame(pages, RAW), used, limits)
    got = sorted((r["module"], r["ts_s"], r["value"], r["message"]) for r in events.collect())
    assert got == [
        ("BTRFS ", 10, 8, "Warning : may be corrupted with 3 IO Errors on btrfs_dev_sda_write_io_errs"),
        ("Disk-Usage-rootfs", 10, 8, "WARNING: Storage usage of rootfs is at 85.00 percent of available  space"),
        ("ElasticSearch-Health", 10, 16, "Cluster: c, Status: red, Shards Active: 5, Relocating: 0, Initializing: 1"),
        ("Load-Average", 10, 0, "OK: System Load average is at 10.00 percent of available  resources"),
        ("Load-Average", 30, 16, "ERROR: System Load average is at 150.00 percent of available  resources"),
        ("Memory-Usage", 10, 16, "ERROR: Systems memory usage is 95.00 percent"),
    ]
    names = {r["name"] for r in samples.collect()}
    assert "elasticsearch_status" not in names and "btrfs_io_errors" not in names and "mem_used_percent" in names


def test_rates_span_the_idle_time_and_shares_need_movement(spark):
    pages = [("h", "network_bytes", f"c{t}", t, "text", f"eth0 {rx} {tx}\nlo 1 1") for t, rx, tx in ((0, 10, 5), (20, 10, 5), (40, 50, 5))]
    pages += [("h", "cpu", f"c{t}", t, "text", line) for t, line in ((0, "cpu 10 0 5 85 0 0 0"), (20, "cpu 20 0 10 170 0 0 0"), (30, "cpu 20 0 10 170 0 0 0"), (40, "cpu 40 0 10 250 0 0 0"))]
    pages += [("h", "elasticsearch", f"c{t}", t, "text", '{"nodes":{"a":{"jvm":{"gc":{"collectors":{"young":{"collection_count":%d,"collection_time_in_millis":%d},'
               '"old":{"collection_count":0,"collection_time_in_millis":0}}}}}}}' % (n, ms)) for t, n, ms in ((0, 2, 10), (20, 6, 40), (40, 6, 40))]
    known = checks.registered()
    out = checks.run_checks(spark.createDataFrame(pages, RAW), [known[n] for n in ("network_bytes", "cpu", "elasticsearch_gc")])
    got = {(r["name"], r["ts_s"]): r["value"] for r in out.collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "bytes_rx"} == {0: 0.0, 40: 1.0}
    assert {k[1]: v for k, v in got.items() if k[0] == "cpu_load"} == {20: 0.0, 40: 20.0}
    assert {k[1]: v for k, v in got.items() if k[0] == "elasticsearch_gc_young_time_ms"} == {0: 5.0, 20: 7.5, 40: 0.0}


def test_devices_that_are_no_whole_disk(spark):
    from tidemark.operators.filters import whole_disk

    disks = ["sda", "sdab", "vdc", "nvme0n1", "mmcblk0", "md0", "dm-0", "sr", "zramdisk"]
    parts = ["sda1", "sdab12", "vdc3", "nvme0n1p2", "mmcblk0p1", "mmcblk0boot0", "sr0", "zram0", "ram1", "loop0", "loop12", "md0p1"]
    df = spark.createDataFrame([(d,) for d in disks + parts], "device string")
    assert sorted(r["device"] for r in df.filter(whole_disk(F.col("device"))).collect()) == sorted(disks)


def test_devices_by_their_object_ids(spark):
    from tidemark.checks.text_services import snmp_check

    names = spark.createDataFrame([("sw1", ".1.3.6.1", "uptime"), ("sw2", ".1.3.6.1", "other")], "device string, oid string, name string")
    raw = spark.createDataFrame([("sw1", "snmp", "c", 1, "text", "iso.3.6.1 = INTEGER: 42\n.1.9.9 = INTEGER: 1")], RAW)
    got = [(r["name"], r["tags"], r["value"]) for r in checks.run_checks(raw, [snmp_check(names)]).collect()]
    assert got == [("snmp_uptime", {"devicename": "sw1"}, 42.0)]


def test_short_lists_are_joined_without_moving_the_rows(spark):
    known = checks.registered()
    rows = spark.createDataFrame([("redis", "used_memory", "h", 1, 95.0, "95", {"k": "v"})] * 3,
                                 "source string, name string, host string, ts_s bigint, value double, value_raw string, tags map<string, string>")
    listed = apply_recipes(rows, checks.recipe_table(spark, [known["redis"]]))
    limits = spark.createDataFrame([("used_memory", 80.0, 90.0, False, True)], THRESHOLDS)
    told = check_events(rows, [Health("used_memory", "M")], limits)
    for df in (listed, told):
        assert df.count() == 3
        assert "BroadcastHashJoin" in df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
