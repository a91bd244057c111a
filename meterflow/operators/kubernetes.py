"""Kubernetes snapshots (pods, services, endpoint slices, nodes) to target groups.

Rows carry ``address`` and ``labels`` (a map); joins run on (namespace, name) keys, nodes by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.exposition import let
from .targets import join_host_port

SERVICE_LABEL = "kubernetes.io/service-name"
P = "__meta_kubernetes_"
EMPTY = "map<string,string>"


def _map(pairs: dict[str, Column]) -> Column:
    """A label map of those pairs whose value is not null."""
    m = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(P + k), v.cast("string"))])
    return F.map_filter(m, lambda k, v: v.isNotNull())


def _marked(meta: Column, prefix: str, kind: str) -> Column:
    """``<kind>_<name>`` and ``<kind>present_<name>`` of a label or annotation map; of names that sanitise alike the last one stays."""
    m = F.coalesce(meta, F.create_map().cast(EMPTY))
    clean = F.transform(F.sort_array(F.map_entries(m)), lambda e: F.struct(L.sanitize_label_name(e["key"]).alias("k"), e["value"].alias("v")))

    def named(entries: Column) -> Column:
        last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"]))
        name = lambda head, e: F.concat(F.lit(f"{P}{prefix}_{head}_"), e["k"])
        values = F.transform(last, lambda e: F.struct(name(kind, e).alias("key"), e["v"].alias("value")))
        flags = F.transform(last, lambda e: F.struct(name(f"{kind}present", e).alias("key"), F.lit("true").alias("value")))
        return F.map_from_entries(F.concat(values, flags))

    return F.get(F.transform(F.array(clean), named), F.lit(0))


def pod_meta_labels() -> Column:
    """Labels of a pod row (columns metadata, spec, status)."""
    owner = F.get(F.filter("metadata.ownerReferences", lambda o: o["controller"]), F.lit(0))
    ready = F.get(F.filter("status.conditions", lambda c: c["type"] == "Ready"), F.lit(0))["status"]
    own = _map(
        {
            "namespace": F.col("metadata.namespace"),
            "pod_name": F.col("metadata.name"),
            "pod_ip": F.coalesce("status.podIP", F.lit("")),
            "pod_ready": F.lower(F.coalesce(ready, F.lit("unknown"))),
            "pod_phase": F.col("status.phase"),
            "pod_node_name": F.col("spec.nodeName"),
            "pod_host_ip": F.col("status.hostIP"),
            "pod_uid": F.col("metadata.uid"),
            "pod_controller_kind": owner["kind"],
            "pod_controller_name": owner["name"],
        }
    )
    return F.map_concat(own, _marked(F.col("metadata.labels"), "pod", "label"), _marked(F.col("metadata.annotations"), "pod", "annotation"))


def containers() -> Column:
    """Regular then init containers, with their flag and id."""
    kind = "array<struct<name:string,image:string,ports:array<struct<name:string,containerPort:int,protocol:string>>>>"
    side = lambda c, flag, s: F.transform(F.coalesce(F.col(c), F.array().cast(kind)), lambda x: F.struct(x["name"].alias("name"), x["image"].alias("image"), x["ports"].alias("ports"), F.lit(flag).alias("init"), container_id_lookup(F.col(s), x["name"]).alias("id")))
    return F.concat(side("spec.containers", "false", "status.containerStatuses"), side("spec.initContainers", "true", "status.initContainerStatuses"))


def container_id_lookup(statuses: Column, name: Column) -> Column:
    return F.coalesce(F.get(F.filter(statuses, lambda s: s["name"] == name), F.lit(0))["containerID"], F.lit(""))


def _port_labels(c: Column, port: Column) -> Column:
    return _map({"pod_container_name": c["name"], "pod_container_image": c["image"], "pod_container_id": c["id"], "pod_container_init": c["init"], "pod_container_port_name": F.when(port.isNotNull(), F.coalesce(port["name"], F.lit(""))), "pod_container_port_number": port["containerPort"], "pod_container_port_protocol": F.when(port.isNotNull(), F.coalesce(port["protocol"], F.lit("")))})


def pod_targets(pods: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row per container and port, or one without port; pods without IP are skipped.

    With ``nodes``, node labels are attached and pods on unknown nodes are dropped.
    """
    df = pods.where(F.coalesce("status.podIP", F.lit("")) != "").withColumn("_meta", pod_meta_labels())
    if nodes is not None:
        df = attach_node_metadata(df, nodes, F.col("spec.nodeName"), "inner").withColumn("_meta", F.map_concat("_meta", "_node"))
    df = L.each(df, containers(), "_c").withColumn("_p", F.explode_outer("_c.ports"))
    ip = F.col("status.podIP")
    address = F.when(F.col("_p").isNull(), ip).otherwise(join_host_port(ip, F.col("_p.containerPort")))
    return df.select(F.col("metadata.namespace").alias("namespace"), F.col("metadata.name").alias("pod"), address.alias("address"), F.map_concat("_meta", _port_labels(F.col("_c"), F.col("_p"))).alias("labels"))


def attach_node_metadata(df: DataFrame, nodes: DataFrame, name: Column, how: str) -> DataFrame:
    """``_node``: name and labels of the row's node ({} for a left join without match)."""
    found = nodes.select(F.col("metadata.name").alias("_nn"), F.map_concat(_map({"node_name": F.col("metadata.name")}), _marked(F.col("metadata.labels"), "node", "label"), _marked(F.col("metadata.annotations"), "node", "annotation")).alias("_nm"))
    out = df.join(found, name == F.col("_nn"), how)
    return out.withColumn("_node", F.coalesce("_nm", F.create_map().cast(EMPTY))).drop("_nn", "_nm")


def attach_endpoint_nodes(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node labels of endpoints: of the Node that they refer to, else of the node that they name; unknown nodes add none."""
    out = attach_node_metadata(targets, nodes, F.col("node"), "left")
    return out.withColumn("labels", L.overlaid(F.col("labels"), F.col("_node"))).drop("_node")


def endpointslice_targets(slices: DataFrame) -> DataFrame:
    """One row per endpoint, port and address, labels only where present; keys for the joins are kept."""
    of_slice = _map({"namespace": F.col("metadata.namespace"), "endpointslice_name": F.col("metadata.name"), "endpointslice_address_type": F.col("addressType")})
    marks = F.map_concat(_marked(F.col("metadata.labels"), "endpointslice", "label"), _marked(F.col("metadata.annotations"), "endpointslice", "annotation"))
    slices = slices.withColumn("_own", F.map_concat(of_slice, marks))
    df = slices.select("_own", "metadata", "addressType", F.explode_outer("ports").alias("port"), "endpoints").withColumn("e", F.explode("endpoints")).withColumn("_a", F.explode("e.addresses"))
    address = F.when(F.col("port.port").isNull(), F.col("_a")).otherwise(join_host_port(F.col("_a"), F.col("port.port")))
    own = _map(
        {
            "endpointslice_port_name": F.col("port.name"),
            "endpointslice_port": F.col("port.port"),
            "endpointslice_port_protocol": F.col("port.protocol"),
            "endpointslice_port_app_protocol": F.col("port.appProtocol"),
            "endpointslice_endpoint_conditions_ready": F.col("e.conditions.ready"),
            "endpointslice_endpoint_conditions_serving": F.col("e.conditions.serving"),
            "endpointslice_endpoint_conditions_terminating": F.col("e.conditions.terminating"),
            "endpointslice_endpoint_hostname": F.col("e.hostname"),
            "endpointslice_endpoint_node_name": F.col("e.nodeName"),
            "endpointslice_endpoint_zone": F.col("e.zone"),
            "endpointslice_address_target_kind": F.col("e.targetRef.kind"),
            "endpointslice_address_target_name": F.col("e.targetRef.name"),
        }
    )
    node = F.when(F.col("e.targetRef.kind") == "Node", F.col("e.targetRef.name")).otherwise(F.col("e.nodeName"))
    pod = F.when(F.col("e.targetRef.kind") == "Pod", F.struct(F.coalesce("e.targetRef.namespace", "metadata.namespace").alias("namespace"), F.col("e.targetRef.name").alias("name")))
    return df.select(F.col("metadata.namespace").alias("namespace"), F.col("metadata.name").alias("slice"), F.try_element_at("metadata.labels", F.lit(SERVICE_LABEL)).alias("service"), pod.alias("pod_ref"), node.alias("node"), F.col("port.port").alias("port"), address.alias("address"), F.map_concat("_own", own).alias("labels"), F.col("_own").alias("slice_labels"))


def join_owning_service(targets: DataFrame, services: DataFrame) -> DataFrame:
    found = services.select(F.col("metadata.namespace").alias("_sn"), F.col("metadata.name").alias("_ss"), F.map_concat(_map({"service_name": F.col("metadata.name")}), _marked(F.col("metadata.labels"), "service", "label"), _marked(F.col("metadata.annotations"), "service", "annotation")).alias("_sm"))
    out = targets.join(found, (F.col("namespace") == F.col("_sn")) & (F.col("service") == F.col("_ss")), "left")
    return out.withColumn("labels", F.when(F.col("_sm").isNull(), F.col("labels")).otherwise(L.add_absent(F.col("labels"), F.col("_sm")))).drop("_sn", "_ss", "_sm")


def match_container_port(cs: Column, port: Column) -> Column:
    """First container (regular before init) with the port, as struct<container, port>."""
    flat = F.flatten(F.transform(cs, lambda c: F.transform(F.coalesce(c["ports"], F.array().cast("array<struct<name:string,containerPort:int,protocol:string>>")), lambda p: F.struct(c.alias("container"), p.alias("port")))))
    return F.get(F.filter(flat, lambda x: x["port"]["containerPort"] == port), F.lit(0))


def join_backing_pod(targets: DataFrame, pods: DataFrame) -> DataFrame:
    """Pod labels by the endpoint's Pod reference; labels that are there already win."""
    found = pods.select(F.col("metadata.namespace").alias("_pn"), F.col("metadata.name").alias("_pp"), pod_meta_labels().alias("_pm"), containers().alias("_cs"))
    out = targets.join(found, (F.col("pod_ref.namespace") == F.col("_pn")) & (F.col("pod_ref.name") == F.col("_pp")), "left")
    of_port = lambda hit: F.when(hit.isNotNull(), F.map_concat("_pm", _port_labels(hit["container"], hit["port"]))).otherwise(F.col("_pm"))
    more = let(match_container_port(F.col("_cs"), F.col("port")), of_port)
    return out.withColumn("labels", F.when(F.col("_pm").isNull(), F.col("labels")).otherwise(L.add_absent(F.col("labels"), more))).drop("_pn", "_pp", "_pm", "_cs")


def uncovered_pod_ports(targets: DataFrame, pods: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Ports of referenced pods that their slice does not cover: namespace, slice, pod, port, address and labels.

    The labels are those of the slice (and of its service, with ``services``) and of the pod, which win; none of the endpoint."""
    refs = targets.where("pod_ref IS NOT NULL").select("namespace", "slice", "service", F.col("pod_ref.namespace").alias("pn"), F.col("pod_ref.name").alias("pp"), "port", "slice_labels")
    # one row for each slice and pod, with the ports that it covers
    refs = refs.groupBy("namespace", "slice", "pn", "pp").agg(F.first("service").alias("service"), F.first("slice_labels").alias("labels"), F.collect_set("port").alias("_ports"))
    if services is not None:
        refs = join_owning_service(refs, services)
    known = pods.where(F.coalesce("status.podIP", F.lit("")) != "").select(F.col("metadata.namespace").alias("_n"), F.col("metadata.name").alias("_p"), "status.podIP", pod_meta_labels().alias("_m"), containers().alias("_cs"))
    met = refs.join(known, (F.col("pn") == F.col("_n")) & (F.col("pp") == F.col("_p"))).withColumn("_c", F.explode("_cs")).withColumn("_port", F.explode("_c.ports"))
    left = met.where(~F.array_contains("_ports", F.col("_port.containerPort")))
    mine = F.map_concat("_m", _port_labels(F.col("_c"), F.col("_port")))
    labels = L.overlaid(F.col("labels"), F.col("_mine"))
    left = left.withColumn("_mine", mine)
    return left.select("namespace", "slice", F.col("pp").alias("pod"), F.col("_port.containerPort").alias("port"), join_host_port(F.col("podIP"), F.col("_port.containerPort")).alias("address"), labels.alias("labels"))
