"""Parameter defaults and presets of the codecs, by backend."""

from __future__ import annotations

MOTION_DEFAULTS = {
    "mv_scale_x": 1.0,
    "mv_scale_y": 1.0,
    "mv_jitter": 0,
    "mv_quant": 1,
    "reference_lag": 1,
    "residual_keep": 1.0,
    "residual_invert_every": 0,
    "residual_address_shift_x": 0,
    "residual_address_shift_y": 0,
    "residual_address_jitter": 0,
    "residual_channel_shift": 0,
    "block_remap_every": 0,
    "block_remap_stride": 0,
    "channel_shift": 0,
    "wrap_motion": False,
    "activity_mode": "all",
    "activity_threshold": 12,
    "activity_softness": 0,
    "reference_bleed": 0.0,
    "reference_latch_frames": 1,
    "reference_slot_count": 1,
    "reference_slot_shuffle_every": 0,
    "reference_scanline_height": 0,
    "reference_scanline_lag_span": 0,
    "temporal_slice_height": 0,
    "temporal_slice_lag_span": 0,
    "temporal_slice_drift": 0,
    "residual_bank_size": 0,
    "residual_bank_stride": 0,
    "residual_bank_shuffle_every": 0,
    "reference_channel_shift": 0,
    "reference_channel_lag_span": 0,
    "reference_channel_lag_stride": 0,
    "mv_bank_size": 0,
    "mv_bank_stride": 0,
    "mv_bank_shuffle_every": 0,
    "overlap": 0,
    "motion_diffusion": 0.0,
    "mv_field_interpolation": 0.0,
    "sample_address_desync": 0.0,
    "glitch_cell_size": 0,
    "glitch_cell_width": 0,
    "glitch_cell_height": 0,
    "mv_predictor_desync_every": 0,
    "mv_predictor_desync_x": 0,
    "mv_predictor_desync_y": 0,
}

BITSTREAM_DEFAULTS = {
    "enabled": False,
    "mv_sign_flip_every": 0,
    "mv_delta_every": 0,
    "mv_delta_x": 0,
    "mv_delta_y": 0,
    "block_address_shift_every": 0,
    "block_address_shift_x": 0,
    "block_address_shift_y": 0,
    "residual_zero_every": 0,
    "residual_xor_every": 0,
    "residual_xor_mask": 255,
    "entropy_slip_every": 0,
    "entropy_slip_bytes": 1,
    "entropy_resync_bytes": 0,
    "entropy_slip_windows": 1,
    "coeff_glitch_every": 0,
    "coeff_block_size": 8,
    "coeff_shift": 0,
    "coeff_sign_flip_every": 0,
    "coeff_zero_high": 0,
    "coeff_quant": 1,
    "codebook_replace_every": 0,
    "codebook_tile_size": 8,
    "codebook_slots": 64,
    "codebook_stride": 1,
    "codebook_update_every": 1,
    "codebook_shuffle_every": 0,
}

#: (name, other names, values that differ from the defaults; cfg. is the codec, bs. the bitstream)
MOTION_PRESETS = [
    ("clean", ("none", "off"), {}),
    ("subtle", (), {"mv_scale_x": 1.06, "mv_scale_y": 1.03, "mv_jitter": 1, "mv_quant": 2, "reference_lag": 2, "residual_keep": 0.75, "activity_mode": "active", "activity_threshold": 10, "activity_softness": 14, "reference_bleed": 0.08, "reference_latch_frames": 4, "overlap": 4, "motion_diffusion": 0.12, "mv_field_interpolation": 0.25, "sample_address_desync": 0.25}),
    ("classic", ("mosh",), {"mv_jitter": 1, "mv_quant": 2, "reference_lag": 3, "residual_keep": 0.22, "activity_mode": "active", "reference_bleed": 0.12, "reference_latch_frames": 5, "reference_slot_count": 4, "reference_slot_shuffle_every": 11, "mv_field_interpolation": 0.7, "sample_address_desync": 0.65, "mv_predictor_desync_every": 17, "mv_predictor_desync_x": 1}),
    ("melt", ("motion-melt",), {"mv_jitter": 1, "mv_quant": 2, "reference_lag": 8, "residual_keep": 0.0, "activity_mode": "active", "activity_threshold": 10, "reference_bleed": 0.16, "reference_latch_frames": 6, "reference_slot_count": 6, "reference_slot_shuffle_every": 9, "mv_field_interpolation": 0.85, "sample_address_desync": 1.15, "mv_predictor_desync_every": 11, "mv_predictor_desync_x": 2, "mv_predictor_desync_y": -1}),
    ("grain", ("medium", "meso"), {"mv_jitter": 1, "reference_lag": 8, "residual_keep": 0.0, "activity_mode": "active", "activity_threshold": 10, "reference_bleed": 0.15, "reference_latch_frames": 6, "reference_slot_count": 7, "reference_slot_shuffle_every": 6, "mv_field_interpolation": 0.88, "sample_address_desync": 1.3, "glitch_cell_width": 3, "glitch_cell_height": 2, "mv_predictor_desync_every": 10, "mv_predictor_desync_x": 2, "mv_predictor_desync_y": -1}),
    ("residue", ("residual",), {"cfg.block_size": 32, "cfg.search_radius": 0, "cfg.search_step": 1, "residual_keep": 1.35, "residual_address_shift_x": 2, "residual_address_jitter": 5, "residual_channel_shift": 1, "activity_threshold": 0, "reference_latch_frames": 4, "glitch_cell_width": 3, "glitch_cell_height": 1}),
    ("scan", ("scanline",), {"cfg.block_size": 32, "cfg.search_radius": 0, "cfg.search_step": 1, "residual_keep": 0.65, "activity_threshold": 0, "reference_latch_frames": 2, "reference_scanline_height": 2, "reference_scanline_lag_span": 4}),
    ("drift", ("slice-drift", "temporal"), {"cfg.block_size": 32, "cfg.search_radius": 0, "cfg.search_step": 1, "residual_keep": 0.75, "activity_threshold": 0, "reference_latch_frames": 2, "temporal_slice_height": 12, "temporal_slice_lag_span": 8, "temporal_slice_drift": 1}),
    ("bank", ("residual-bank", "swap"), {"cfg.block_size": 32, "cfg.search_radius": 0, "cfg.search_step": 1, "residual_keep": 1.2, "residual_channel_shift": 1, "residual_bank_size": 24, "residual_bank_stride": 5, "residual_bank_shuffle_every": 3, "activity_threshold": 0, "reference_latch_frames": 3}),
    ("plane", ("channel-plane", "rgb-plane"), {"cfg.block_size": 32, "cfg.search_radius": 0, "cfg.search_step": 1, "residual_keep": 0.85, "residual_channel_shift": -1, "reference_channel_shift": 1, "reference_channel_lag_span": 6, "reference_channel_lag_stride": 1, "activity_threshold": 0, "reference_latch_frames": 3}),
    ("vector", ("vector-bank", "field"), {"cfg.block_size": 24, "mv_jitter": 1, "mv_quant": 2, "reference_lag": 5, "residual_keep": 0.16, "mv_bank_size": 2, "mv_bank_stride": 3, "mv_bank_shuffle_every": 4, "activity_mode": "active", "activity_threshold": 8, "activity_softness": 6, "reference_bleed": 0.12, "reference_latch_frames": 4, "reference_slot_count": 4, "mv_field_interpolation": 0.82, "sample_address_desync": 0.45, "mv_predictor_desync_every": 13, "mv_predictor_desync_x": 1, "mv_predictor_desync_y": -1}),
    ("entropy", ("byte-slip", "stream-slip"), {"cfg.search_radius": 4, "activity_threshold": 0, "reference_latch_frames": 3, "bs.enabled": True, "bs.entropy_slip_every": 2, "bs.entropy_resync_bytes": 4096, "bs.entropy_slip_windows": 4}),
    ("entropy-hard", ("byte-slip-hard", "stream-slip-hard"), {"cfg.search_radius": 4, "activity_threshold": 0, "reference_latch_frames": 3, "bs.enabled": True, "bs.entropy_slip_every": 1, "bs.entropy_resync_bytes": 8192, "bs.entropy_slip_windows": 10}),
    ("coeff", ("coefficient", "transform", "frequency"), {"cfg.search_radius": 4, "activity_threshold": 0, "reference_latch_frames": 2, "bs.enabled": True, "bs.coeff_glitch_every": 1, "bs.coeff_shift": 2, "bs.coeff_sign_flip_every": 19, "bs.coeff_zero_high": 12, "bs.coeff_quant": 4}),
    ("coeff-hard", ("coefficient-hard", "transform-hard", "frequency-hard"), {"cfg.search_radius": 4, "activity_threshold": 0, "reference_latch_frames": 2, "bs.enabled": True, "bs.coeff_glitch_every": 1, "bs.coeff_shift": 5, "bs.coeff_sign_flip_every": 7, "bs.coeff_zero_high": 9, "bs.coeff_quant": 8}),
    ("codebook", ("dictionary", "dict"), {"cfg.search_radius": 4, "activity_threshold": 0, "reference_latch_frames": 4, "bs.enabled": True, "bs.codebook_replace_every": 9, "bs.codebook_slots": 96, "bs.codebook_stride": -17, "bs.codebook_update_every": 3, "bs.codebook_shuffle_every": 5}),
    ("codebook-hard", ("dictionary-hard", "dict-hard"), {"cfg.search_radius": 4, "activity_threshold": 0, "reference_latch_frames": 4, "bs.enabled": True, "bs.codebook_replace_every": 4, "bs.codebook_slots": 128, "bs.codebook_stride": -31, "bs.codebook_update_every": 2, "bs.codebook_shuffle_every": 2}),
    ("pixel", ("pixel-melt", "micro"), {"mv_jitter": 1, "reference_lag": 8, "residual_keep": 0.0, "activity_mode": "active", "activity_threshold": 10, "reference_bleed": 0.14, "reference_latch_frames": 5, "reference_slot_count": 8, "reference_slot_shuffle_every": 5, "mv_field_interpolation": 0.9, "sample_address_desync": 1.25, "glitch_cell_size": 1, "glitch_cell_width": 1, "glitch_cell_height": 1, "mv_predictor_desync_every": 9, "mv_predictor_desync_x": 2, "mv_predictor_desync_y": -1}),
    ("unstable", ("desync",), {"mv_jitter": 2, "mv_quant": 2, "reference_lag": 10, "residual_keep": 0.0, "activity_mode": "active", "activity_threshold": 8, "reference_bleed": 0.24, "reference_latch_frames": 9, "reference_slot_count": 10, "reference_slot_shuffle_every": 7, "mv_field_interpolation": 0.85, "sample_address_desync": 1.8, "mv_predictor_desync_every": 7, "mv_predictor_desync_x": 3, "mv_predictor_desync_y": -2}),
    ("balanced", (), {"mv_scale_x": 1.22, "mv_scale_y": 1.12, "mv_jitter": 2, "mv_quant": 3, "reference_lag": 3, "residual_keep": 0.45, "block_remap_every": 9, "block_remap_stride": 5, "channel_shift": 1, "activity_mode": "active", "activity_threshold": 8, "activity_softness": 8, "reference_bleed": 0.12, "reference_latch_frames": 4, "reference_slot_count": 4, "reference_slot_shuffle_every": 9, "overlap": 4, "motion_diffusion": 0.2, "mv_field_interpolation": 0.55, "sample_address_desync": 0.9, "mv_predictor_desync_every": 11, "mv_predictor_desync_x": 1, "mv_predictor_desync_y": 1}),
    ("destroy", (), {"mv_scale_x": 1.8, "mv_scale_y": 1.8, "mv_jitter": 4, "reference_lag": 3, "residual_keep": 0.0, "block_remap_every": 5, "block_remap_stride": 17, "channel_shift": 3, "wrap_motion": True, "activity_threshold": 0}),
]

SCANLINE_DEFAULTS = {
    "line_shift": 0,
    "line_shift_every": 0,
    "line_shift_drift": 0,
    "line_index_offset": 0,
    "line_index_every": 0,
    "line_index_stride": 0,
    "sync_loss_every": 0,
    "field_sync_loss_every": 0,
    "field_parity_flip_every": 0,
    "phase_offset": 0,
    "phase_drift": 0,
    "burst_loss_every": 0,
    "predictor_flip_every": 0,
    "predictor_lag": 1,
    "predictor_line_offset": 0,
    "predictor_line_offset_every": 0,
    "quant_offset": 0,
    "quant_offset_every": 0,
    "luma_payload_slip": 0,
    "luma_payload_slip_every": 0,
    "chroma_payload_slip": 0,
    "chroma_payload_slip_every": 0,
    "carrier_sign_flip_every": 0,
    "chroma_group_delta": 0,
    "chroma_sequence_offset": 0,
    "chroma_sequence_every": 0,
    "chroma_seed_loss_every": 0,
    "chroma_xor_mask": 0,
    "chroma_xor_every": 0,
    "luma_run_delta": 0,
    "luma_run_delta_every": 0,
    "packet_length_delta": 0,
    "packet_length_delta_every": 0,
    "payload_swap_every": 0,
    "history_line_weave": 0,
    "history_line_weave_every": 0,
}

#: (name, other names, values that differ from the defaults)
SCANLINE_PRESETS = [
    ("clean", (), {}),
    ("subtle", (), {"line_shift": 2, "line_shift_every": 13, "burst_loss_every": 23}),
    ("classic", ("tear", "timebase-tear"), {"line_shift": 14, "line_shift_every": 6}),
    ("vector", ("clock-skew",), {"line_shift": 2, "line_shift_every": 1}),
    ("drift", ("vertical-roll",), {"line_index_offset": 8, "line_index_every": 1}),
    ("sync", ("sync-dropout",), {"sync_loss_every": 9, "field_sync_loss_every": 2, "field_parity_flip_every": 4, "predictor_lag": 3}),
    ("plane", ("phase", "phase-walk"), {"phase_drift": 1, "chroma_sequence_offset": 1, "chroma_sequence_every": 5}),
    ("carrier", ("carrier-slip",), {"phase_offset": 1, "chroma_sequence_offset": 1, "chroma_sequence_every": 3, "chroma_payload_slip": 3, "chroma_payload_slip_every": 5}),
    ("chroma-grid", (), {"chroma_group_delta": 1, "phase_offset": 1, "chroma_seed_loss_every": 9}),
    ("chroma-sequence", (), {"chroma_sequence_offset": 1, "chroma_sequence_every": 1}),
    ("burst-seed-loss", (), {"chroma_seed_loss_every": 4, "burst_loss_every": 7}),
    ("carrier-xor", (), {"chroma_xor_mask": 96, "chroma_xor_every": 3, "carrier_sign_flip_every": 11}),
    ("melt", ("ghost", "predictor-ghost"), {"predictor_lag": 5, "predictor_flip_every": 8}),
    ("line-crosstalk", (), {"predictor_lag": 3, "predictor_line_offset": 8, "predictor_line_offset_every": 3}),
    ("residue", ("rle-runaway",), {"luma_run_delta": 5, "luma_run_delta_every": 7, "luma_payload_slip": 1, "luma_payload_slip_every": 17}),
    ("entropy", ("packet-length",), {"packet_length_delta": 3, "packet_length_delta_every": 13}),
    ("plane-crosswire", (), {"payload_swap_every": 11}),
    ("coeff", ("quantizer-pump",), {"quant_offset": 4, "quant_offset_every": 5}),
    ("codebook", ("weave", "history-weave"), {"predictor_lag": 5, "history_line_weave": 4, "history_line_weave_every": 5, "predictor_flip_every": 13}),
    ("unstable", ("balanced", "destroy", "composite", "composite-collapse"), {"line_shift": 12, "line_shift_every": 6, "line_shift_drift": 1, "line_index_offset": 1, "line_index_every": 13, "line_index_stride": 1, "sync_loss_every": 31, "field_sync_loss_every": 2, "field_parity_flip_every": 3, "phase_offset": 1, "burst_loss_every": 11, "predictor_flip_every": 9, "predictor_lag": 4, "predictor_line_offset": 5, "predictor_line_offset_every": 12, "quant_offset": 3, "quant_offset_every": 7, "luma_payload_slip": 2, "luma_payload_slip_every": 8, "chroma_payload_slip": -2, "chroma_payload_slip_every": 9, "chroma_sequence_offset": 1, "chroma_sequence_every": 7, "chroma_seed_loss_every": 19, "chroma_xor_mask": 32, "chroma_xor_every": 23, "luma_run_delta": 3, "luma_run_delta_every": 17, "packet_length_delta": 2, "packet_length_delta_every": 29, "payload_swap_every": 37, "history_line_weave": 3, "history_line_weave_every": 10}),
]

TRANSFORM_DEFAULTS = {
    "quant_scale": 1.0,
    "dc_drift": 0,
    "dc_drift_every": 0,
    "dc_block_offset": 0,
    "dc_block_offset_every": 0,
    "ac_zero_above": 0,
    "coeff_sign_flip_every": 0,
    "coeff_shift": 0,
    "coeff_shift_every": 0,
    "block_shift_x": 0,
    "block_shift_y": 0,
    "block_shift_every": 0,
    "block_repeat_every": 0,
    "zigzag_reverse_every": 0,
    "block_transpose_every": 0,
    "chroma_swap_every": 0,
    "persistence": 0.0,
}

#: (name, other names, values that differ from the defaults)
TRANSFORM_PRESETS = [
    ("clean", (), {}),
    ("subtle", (), {"quant_scale": 2.0}),
    ("blocks", ("quantize", "coeff"), {"quant_scale": 8.0}),
    ("smear", ("dc-smear", "melt"), {"dc_drift": 12, "dc_drift_every": 80, "persistence": 0.5}),
    ("bleed", ("drift",), {"dc_block_offset": 24, "dc_block_offset_every": 5}),
    ("blur", ("lowpass",), {"ac_zero_above": 3, "quant_scale": 2.0}),
    ("ring", ("invert",), {"coeff_sign_flip_every": 3, "block_transpose_every": 5}),
    ("scramble", ("shuffle",), {"coeff_shift": 7, "coeff_shift_every": 2, "zigzag_reverse_every": 11}),
    ("slip", ("block-slip", "vector"), {"block_shift_x": 3, "block_shift_y": 1, "block_shift_every": 4}),
    ("echo", ("repeat", "codebook"), {"block_repeat_every": 5}),
    ("flow", ("feedback", "drift-flow"), {"dc_block_offset": 18, "dc_block_offset_every": 6, "persistence": 0.7}),
    ("desync", ("entropy", "decoder-desync"), {}),
    ("shred", ("scan-slip",), {}),
    ("truncate", ("tail",), {}),
    ("false-color", ("falsecolor", "chroma-swap"), {"chroma_swap_every": 2, "dc_drift": 8, "dc_drift_every": 50}),
    ("destroy", ("composite", "unstable", "balanced"), {"quant_scale": 5.0, "dc_drift": 7, "dc_drift_every": 96, "dc_block_offset": 12, "dc_block_offset_every": 11, "ac_zero_above": 6, "coeff_sign_flip_every": 17, "coeff_shift": 5, "coeff_shift_every": 7, "block_shift_x": 2, "block_shift_y": 1, "block_shift_every": 19, "block_repeat_every": 23, "zigzag_reverse_every": 29, "block_transpose_every": 31, "chroma_swap_every": 37, "persistence": 0.4}),
]

ENTROPY_DEFAULTS = {
    "enabled": False,
    "byte_flip_every": 0,
    "drop_every": 0,
    "slip_every": 0,
    "slip_bytes": 1,
    "slip_window": 64,
    "truncate_tail": 0.0,
}

#: (name, other names, values that differ from the defaults)
ENTROPY_PRESETS = [
    ("desync", ("entropy", "decoder-desync"), {"enabled": True, "byte_flip_every": 220, "drop_every": 400}),
    ("shred", ("scan-slip",), {"enabled": True, "slip_every": 2, "slip_bytes": 5, "slip_window": 48, "byte_flip_every": 700}),
    ("truncate", ("tail",), {"enabled": True, "truncate_tail": 0.35, "drop_every": 1500}),
]

WAVELET_DEFAULTS = {
    "packet_shift": 0,
    "packet_shift_every": 0,
    "orientation_rotate": 0,
    "orientation_rotate_every": 0,
    "level_fold": 0,
    "level_fold_every": 0,
    "channel_route": 0,
    "channel_route_every": 0,
    "packet_loss_every": 0,
    "packet_loss_conceal": True,
    "bitplane_clear": 0,
    "bitplane_clear_every": 0,
    "bitplane_xor": 0,
    "bitplane_xor_every": 0,
    "sign_flip_every": 0,
    "history_lag": 1,
    "history_band_every": 0,
    "lowpass_history_lag": 0,
    "lifting_bias": 0,
    "lifting_bias_every": 0,
}

#: (name, other names, values that differ from the defaults)
WAVELET_PRESETS = [
    ("clean", (), {}),
    ("subband-slip", (), {"packet_shift": 2, "packet_shift_every": 5}),
    ("orientation-cross", (), {"orientation_rotate": 1, "orientation_rotate_every": 3}),
    ("scale-fold", (), {"level_fold": 1, "level_fold_every": 4}),
    ("bitplane-rain", (), {"bitplane_clear": 2, "bitplane_clear_every": 3, "bitplane_xor": 4, "bitplane_xor_every": 11}),
    ("lowpass-ghost", (), {"lowpass_history_lag": 5}),
    ("temporal-weave", (), {"history_lag": 6, "history_band_every": 3}),
    ("packet-loss", (), {"history_lag": 3, "packet_loss_every": 5}),
    ("lifting-drift", (), {"lifting_bias": 12, "lifting_bias_every": 7}),
    ("chroma-pyramid", (), {"channel_route": 1, "channel_route_every": 4, "level_fold": -1, "level_fold_every": 7}),
    ("hierarchy-collapse", (), {"packet_shift": 5, "packet_shift_every": 4, "orientation_rotate": 1, "orientation_rotate_every": 5, "level_fold": 1, "level_fold_every": 6, "bitplane_clear": 2, "bitplane_clear_every": 3, "history_lag": 4, "history_band_every": 5, "packet_loss_every": 9, "lifting_bias": 8, "lifting_bias_every": 11}),
]

FILTER_DEFAULTS = {
    "codec": "h264",
    "drop_idr_after": 1,
    "recover_every": 0,
    "drop_slice_every": 0,
    "damage_slice_every": 0,
    "damage_amount": 4,
    "truncate_slice_every": 0,
    "truncate_amount": 16,
    "scramble_slice_every": 0,
    "scramble_amount": 16,
    "rotate_slice_every": 0,
    "rotate_amount": 8,
    "splice_slice_every": 0,
    "splice_amount": 32,
    "grow_slice_every": 0,
    "grow_amount": 8,
    "donor_bank_size": 16,
    "donor_splice_slice_every": 0,
    "donor_splice_amount": 32,
    "donor_grow_slice_every": 0,
    "donor_grow_amount": 8,
    "donor_xor_slice_every": 0,
    "donor_xor_amount": 16,
    "donor_replace_slice_every": 0,
    "rewrite_frame_type_every": 0,
    "rewrite_frame_type_to": "p",
    "shift_slice_address_every": 0,
    "shift_slice_address_by": 1,
    "drop_mpeg_slice_address_every": 0,
    "drop_mpeg_slice_address_phase": 0,
    "drop_mpeg_slice_address_mode": "all",
    "xor_slice_every": 0,
    "xor_amount": 16,
    "echo_slice_every": 0,
    "echo_count": 1,
    "replace_slice_every": 0,
    "repeat_slice_every": 0,
    "repeat_count": 1,
    "drop_headers_after_first": False,
    "quiet": False,
}
